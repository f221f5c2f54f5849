"""Long items: recall at the radius, and items beyond the walk's constants."""

import random

import pytest

from strandmill.llm import decontamination as dc
from tests.llm.helpers import docs, prose
from tests.llm.test_text_operators import edit


def test_heads():
    for n in [*range(5, 700), 5000]:
        size, starts = dc.heads_of(n)
        assert starts[0] == 0 and starts[-1] + size <= n and all(a + size <= b for a, b in zip(starts, starts[1:])) and size <= 78
        assert n <= dc.WHOLE or starts[-1] + size == n and len(starts) * size >= 0.75 * n


@pytest.mark.parametrize("size, count", [(100, 40), (125, 40), (150, 40), (300, 40), (400, 40), (800, 30), (3000, 4)])
def test_recall_of_long_items(size, count):
    rng = random.Random(size)
    items = [(k, prose(100 * size + k, size, 2000)) for k in range(count)]
    index = dc.ItemIndex(items)
    found = 0
    for k, text in items:
        body = edit([w.decode() for w in dc.words_of(text)], dc.allowed(size), rng)
        around = prose(7000 + size + k, 200, 2000).split()
        found += any(m == k for _, m, *_ in index.matches([dc.words_of(" ".join(around[:100] + body + around[100:]))]))
    assert found >= 0.9 * count


def test_item_of_5000_words(spark):
    text = prose(1, 5000, 3000)
    words = text.split()
    bench = spark.createDataFrame([(1, text), (2, prose(2, 30))], "item_id long, text string")
    rows = [(1, "before " + text + " after"), (2, prose(3, 6000, 3000)), (3, " ".join(words[:2000] + ["new"] + words[2100:])), (4, "x " + prose(2, 30))]
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["end_word"], r["edits"]) for r in dc.contamination(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 2)} and got[1, 1] == (1, 5001, 0) and got[3, 1][2] == 100
