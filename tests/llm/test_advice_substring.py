"""Repeated passages of 50 words and more, planted in mid-sentence."""

import random

from strandmill.llm import substring_dedup
from tests.llm.helpers import docs


def words(rng, n, marks):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) + ("." if rng.random() < marks else "") for _ in range(n)]


def test_planted_passages_are_found(spark):
    """Every passage that a word-level brute force finds is found, and what is found is repeated word for word."""
    rng, rows = random.Random(4), []
    for k in range(240):
        shared = words(rng, rng.randint(50, 80), (0, 0.03, 0.06, 0.3)[k % 4])
        for half in range(2):
            rows.append((2 * k + half, " ".join(words(rng, rng.randint(3, 40), 0.05) + ["own"] + shared + words(rng, rng.randint(3, 40), 0.05))))
    got: dict = {}
    for r in substring_dedup.repeated_spans(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    seen = {}
    for i, text in rows:
        own = text.split()
        for a in range(len(own) - 49):
            seen.setdefault(tuple(own[a : a + 50]), []).append(i)
    want = {max(ids) for ids in seen.values() if len(ids) > 1}
    assert want == {i for i, _ in rows if i % 2} == set(got)
    text = dict(rows)
    for i, spans in got.items():
        for a, b in spans:
            piece = text[i][a:b].strip()
            assert piece in text[i - 1] and len(piece.split()) >= substring_dedup.SPAN


def test_no_long_clause():
    rng = random.Random(1)
    for marks in (0, 0.02, 0.2):
        text = " ".join(words(rng, 3000, marks))
        assert max(len(text[a:b].split()) for a, b in substring_dedup.clauses(text)) <= substring_dedup.WINDOW
