import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import exact_dedup, near_dedup
from tests.llm.helpers import ODD, docs, prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(spark):
    rows = [*ODD, (9, "Same TEXT"), (10, "same text"), (11, "same text "), (12, "É"), (13, "é"), (14, prose(1, 9000)), (15, prose(1, 9000).upper())]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_exact_empty_and_filter(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, "b"), (None, "c"), (4, None), (5, "")]
    out = exact_dedup.drop_exact_copies(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, "A"), (3, "b"), (None, "c"), (5, "")], key=str)


@given(st.binary(min_size=0, max_size=60_000), st.binary(max_size=300))
@settings(max_examples=20, deadline=None)
def test_chunks_follow_content(data, lead):
    ends = exact_dedup.cut_points(data)
    assert (ends[-1] == len(data)) if data else ends == []
    sizes = np.diff([0, *ends])
    assert all(s > 0 for s in sizes) and all(s <= exact_dedup.MAX_CHUNK for s in sizes)


def test_chunks_are_shared():
    body = np.random.default_rng(0).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    cut = lambda d: {d[a:b] for a, b in zip([0, *exact_dedup.cut_points(d)], exact_dedup.cut_points(d))}
    a, b = cut(body), cut(b"some words in front" + body)
    assert len(a & b) > 0.9 * len(a)


def test_digests_replace_clashing_ids(spark):
    rows = spark.createDataFrame([([1, 2], [bytearray(b"a" * 32), bytearray(b"b" * 32)]), ([1], [bytearray(b"c" * 32)])], "ids array<long>, digests array<binary>")
    got = {r["id"]: (r["uses"], r["verified"]) for r in exact_dedup.dictionary(rows).collect()}
    assert got == {1: (2, False), 2: (1, True)}


def fingerprint(text):
    import xxhash

    words = [w for w in lower(text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 4:
                label[root(a)] = root(b)
    return {f: root(f) for f in fs}


def test_near_groups(spark):
    base = prose(3, 4000)
    rows = [*ODD[:10], *[(20 + k, base.replace(base.split()[k * 30], "changed", 1)) for k in range(12)], *[(40 + k, prose(k, 50 + k)) for k in range(10)], (60, base), (61, base.upper())]
    got = near_dedup.near_groups(docs(spark, rows)).collect()
    want = [(i, fingerprint(t)) for i, t in rows]
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16)) for r in got), key=str) == sorted(want, key=str)
    roots = brute([f for _, f in want])
    names = defaultdict(list)
    for i, f in want:
        names[roots[f]] += [i] if i is not None else []
    for r in got:
        ids = names[roots[int(r["fingerprint"], 16)]]
        assert r["component_id"] == (min(ids) if ids else None)
    assert len({r["component_id"] for r in got}) < len(rows) - 10


def cluster(seed, n, flips):
    rng = np.random.default_rng(seed)
    out = [int(rng.integers(0, 1 << 63))]
    for _ in range(n):
        x = out[int(rng.integers(0, len(out)))]
        for b in rng.choice(64, int(rng.integers(1, flips + 1)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def components_of(nodes, pairs):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[root(a)] = root(b)
    return {frozenset(n for n in nodes if root(n) == r) for r in {root(n) for n in nodes}}


@pytest.mark.parametrize("dense", [3, 256])
def test_buckets_lose_no_link(dense, monkeypatch):
    """The bucket pass and, for dense buckets, the ball pass connect what brute force connects."""
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    fps = cluster(1, 60, 6) + cluster(2, 40, 3) + cluster(5, 5, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64))], names=["fp"])
    rows = pa.Table.from_batches(list(near_dedup._sub_variants([batch]))).sort_by([("bucket", "ascending"), ("fp", "ascending")])
    found = [r for b in near_dedup._bucket_links(rows.to_batches(max_chunksize=97)) for r in zip(*(b.column(k).to_pylist() for k in range(2)))]
    u = lambda x: x % (1 << 64)
    pairs = [(u(a), u(b)) for a, b in found if b is not None]
    tight = sorted({u(a) for a, b in found if b is None})
    if tight:
        ball = pa.Table.from_batches(list(near_dedup._ball([pa.RecordBatch.from_arrays([pa.array(np.array(tight, np.uint64).view(np.int64))], names=["fp"])]))).to_pandas()
        for _, m in ball.groupby("bucket")["fp"]:
            pairs += [(u(int(m.iloc[0])), u(int(x))) for x in m]
    want = components_of(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])
    assert components_of(fps, pairs) == want
    assert (dense == 3) == bool(tight)


def test_ball_links(spark):
    fps = cluster(7, 25, 4)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in near_dedup.ball_links(df).collect()]
    assert components_of(fps, pairs) == components_of(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])


def test_components(spark):
    from strandmill.llm.common import components

    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 110)] + [(1, int(x)) for x in range(200, 230)] + [tuple(map(int, rng.integers(300, 360, 2))) for _ in range(25)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = {n: min(c) for c in components_of(nodes, [e for e in edges if e[0] != e[1]]) for n in c}
    assert got == want


def test_near_empty_and_filter(spark):
    assert near_dedup.near_groups(docs(spark, [])).count() == 0
    rows = [(5, "a b c d e"), (3, "a b c d e"), (9, "other words stand here now")]
    out = near_dedup.drop_near_copies(docs(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9] and out.columns == docs(spark, rows).columns
