"""The stages of the pipeline on odd input: null and repeated ids, repeated rows, clashing columns, empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from strandmill.llm import common, decontamination, exact_dedup, near_dedup, packing, substring_dedup, toxicity
from tests.llm.helpers import prose

CLASH = "doc_id long, text string, lang string, source string, n_chars long, __id long, __sha string, __sha0 string, file string, at int, row0 int, row1 int, fp string, recipe string, keep_id string, least string, hash string, cuts string, whole string, score string, toxic string"
ITEM = prose(500, 40)


def table(spark, rows):
    names = [c.split()[0] for c in CLASH.split(", ")]
    kinds = [c.split()[1] for c in CLASH.split(", ")]
    return spark.createDataFrame([(i, t, *[{"string": f"{n}{k}", "long": k, "int": k}[kind] for n, kind in zip(names[2:], kinds[2:])]) for k, (i, t) in enumerate(rows)], CLASH)


ROWS = [
    (1, prose(1, 60)), (2, prose(1, 60).upper()), (2, prose(1, 60)), (None, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60)), (3, None), (4, ""), (None, ""), (5, "x " + ITEM + " y"), (None, "z " + ITEM), (5, prose(3, 80)),
    (6, "you moron " + prose(4, 50)), (None, "what a moron " + prose(5, 50)), (7, prose(6, 300)), (8, prose(6, 300) + "  "), (7, prose(6, 300)),
]


@pytest.fixture(params=["memory", "parquet"])
def docs(request, spark, tmp_path):
    made = table(spark, ROWS)
    if request.param == "parquet":
        made.repartition(3).write.parquet(str(tmp_path / "d"))
        return spark.read.parquet(str(tmp_path / "d"))
    return made


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, " "), (4, "Zq")], "item_id long, text string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_copies(docs):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    want = {}
    for i, t in ROWS:
        want.setdefault(lower(t), []).append(i)
    rows = out.collect()
    assert len(rows) == len(want) and {lower(r["text"]) for r in rows} == set(want)
    for r in rows:
        known = [i for i in want[lower(r["text"])] if i is not None]
        assert r["doc_id"] == (max(known) if known else None)
        assert r["__sha0"] == f"__sha0{r['n_chars']}" and ROWS[r["n_chars"]] == (r["doc_id"], r["text"])


def test_near_copies(docs):
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    groups = {}
    for r in near_dedup.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect():
        groups.setdefault(r["fingerprint"], r["component_id"])
    kept = Counter(groups[f"{near_dedup.simhash(r['text']):016x}"] for r in rows)
    assert all(r["doc_id"] == groups[f"{near_dedup.simhash(r['text']):016x}"] for r in rows)
    assert all(n == (2 if c == 5 else 1) for c, n in kept.items() if c is not None) and set(kept) == set(groups.values())  # two texts have id 5
    assert [r["doc_id"] for r in rows if lower(r["text"]) in (prose(6, 300), lower(ROWS[15][1]))] == [7]
    assert sum(r["doc_id"] is None for r in rows) == 3


def test_contaminated(docs, bench):
    out = decontamination.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r["n_chars"] for r in out.collect()) == [k for k, (_, t) in enumerate(ROWS) if ITEM not in (t or "")]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "solo"), (2, "two words"), (3, "a b c d"), (4, "a b c d e")], "item_id long, text string")
    rows = [(1, "it is solo here"), (2, "two, Words!"), (3, "x a b c d y"), (4, "a b x d e"), (5, "words two"), (6, None), (7, "a b c x d")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (3, 4), (4, 4)}


def test_toxic(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    assert sorted(r["n_chars"] for r in out.collect()) == [k for k, (_, t) in enumerate(ROWS) if "moron" not in (t or "")]


def test_pack(docs):
    out = packing.pack(docs, added=True).collect()
    ends = [r for r in out if r["start"] + r["length"] == r["doc_tokens"]]
    assert Counter(r["doc_id"] for r in ends) == Counter(i for i, _ in ROWS)
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in ends)


def test_packing_leftovers(spark, monkeypatch):
    """Many workers with few pieces each: no sequence but the last of a share is padded, and offsets have no gaps."""
    monkeypatch.setattr(packing, "SHARE", 4)
    rows = spark.createDataFrame([(k, prose(k, 1 + 97 * k % 400)) for k in range(120)], "doc_id long, text string").repartition(40)
    bins = {}
    for r in packing.pack(rows).collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in b) & (sum(n for _, n in b) - 1) != 0 for b in bins.values()) <= len(bins) // 3


def test_repeats(docs):
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    text = {r["n_chars"]: r["text"] for r in out.collect()}
    assert text[0] == ROWS[0][1] and text[2].strip() == "" and text[6] is None and text[7] == ""


def test_empty(spark, bench):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.drop_exact_copies(none), near_dedup.drop_near_copies(none), decontamination.drop_contaminated(none, bench), toxicity.drop_toxic(none, labels), substring_dedup.drop_repeats(none)):
        assert out.count() == 0 and out.columns == none.columns
    assert packing.pack(none).count() == 0


def test_pipeline_on_odd_documents(spark, tmp_path, bench):
    table(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {2, 4, 5, 7, None} and not any("pipeline-" in str(p) for p in tmp_path.rglob("*"))


def test_addresses_are_the_same_at_every_reading(spark, tmp_path):
    spark.range(500).repartition(7).selectExpr("id as doc_id", "cast(id as string) as text", "1 as file", "2 as FILE_").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows, names = common.addressed(docs)
    again, _ = common.addressed(docs.where("doc_id % 3 = 0").select("doc_id", "file", "FILE_"))
    assert names == ["file__", "at"] and rows.select(*names).distinct().count() == 500
    assert rows.join(again.withColumnRenamed("doc_id", "other"), names).where("doc_id = other").count() == 167


def test_meet_gives_the_same_beyond_its_bound(spark, monkeypatch):
    rows = spark.range(50).selectExpr("id as k", "id as v")
    facts = spark.range(0, 100, 7).selectExpr("id as k")
    want = sorted(r["k"] for r in common.meet(rows, facts, ["k"], "left_anti").collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert sorted(r["k"] for r in common.meet(rows, facts, ["k"], "left_anti").collect()) == want and len(want) == 42


def test_hot_limit():
    for total in (0, 10, 10**6, 10**9, 10**11, 10**13):
        limit = common.hot_limit(total)
        assert total == 0 or total / limit <= max(common.HOT_SHARE, common.HOT_KEYS) * 1.0001
        assert limit <= max(common.HOT_ROWS, total / common.HOT_KEYS)
