"""Near-duplicate detection: SimHash fingerprints, linked by meet-in-the-middle ball hashing.

Two values within 2r differing bits share a value within r bits of both. So every fingerprint emits all variants within
half the radius, the variants are shuffled, and those that collide are deduplicated and verified. On whole fingerprints
at radius 4 a fingerprint has 2081 variants. The same step on sub-keys needs 132: of 4 differing bits over three blocks,
some two blocks hold at most 2 (the third holds at least the larger part), so each of the three pairs of blocks, 42 or 43
bits, emits its variants within 1 bit. No link is lost. Colliding fingerprints are verified on all 64 bits in their
bucket. Buckets of more than ``DENSE`` fingerprints, as a page copied a thousand times with small edits makes them, are
not compared pair by pair: their members go through the 2081 whole-fingerprint variants, where all members of a bucket
link by the triangle inequality and a bucket can't hold more than 2081, so a star replaces the pairs.

Defined cases: null or blank text gives fingerprint zero, linked like any other. A null doc_id never names a component
if the component has another id. Repeated rows give repeated results. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import LOWER_TABLE, addressed, components, durable, join_facts, meet

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
DENSE = 256
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15
#: (mask, bits) of the three pairs of blocks of 21, 21 and 22 bits.
_BLOCKS = [range(0, 21), range(21, 42), range(42, 64)]
_PAIRS = [sorted([*a, *b]) for a, b in combinations(_BLOCKS, 2)]


def simhash(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of the 4-word shingles of ``text``, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = [0, *ends[:-SHINGLE_WORDS].tolist()], (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(last)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([simhash(t) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id long, fp long), fp the fingerprint's 64 bits as a signed long; in front the long columns ``carry`` as row0, row1, ..."""
    rows = [F.col(c).alias(f"row{k}") for k, c in enumerate(carry or [])]
    schema = "".join(f"row{k} long, " for k in range(len(rows))) + "doc_id long, fp long"
    return docs.select(*rows, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, schema)


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _sub_variants(batches):
    """(bucket, fp): all variants within 1 bit of each pair of blocks; two bits outside the pair are set to name it."""
    flips = []
    for k, bits in enumerate(_PAIRS):
        free = [b for b in range(64) if b not in bits][:2]
        name = ((k & 1) << free[0]) | ((k >> 1) << free[1])
        flips.append((np.uint64(_mask(bits)), np.uint64(name), np.array([0, *[1 << b for b in bits]], dtype=np.uint64)))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096].view(np.uint64)
            for mask, name, masks in flips:
                keys = (((part & mask)[:, None] ^ masks[None, :]) | name).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["bucket", "fp"])


def _star(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what verified links of ``members`` (unsigned) connect."""
    if len(members) == 2:
        a, b = members.tolist()
        return [(b, a)] if (a ^ b).bit_count() <= RADIUS else []
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= RADIUS
    label = np.arange(len(members))
    while True:
        low = np.where(near, label[None, :], len(members)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    hit = np.flatnonzero(label != np.arange(len(members)))
    return list(zip(members[hit].tolist(), members[label[hit]].tolist()))


def _bucket_links(batches):
    """From rows sorted by (bucket, fp): verified links (a, b), and (a, null) for members of dense buckets."""
    held_key, held, dense = None, [], False
    seen: set[tuple[int, int]] = set()

    def close():
        rows = []
        if dense:
            rows = [(x, None) for x in held]
        elif len(held) > 1:
            rows = _star(np.unique(np.array(held, dtype=np.uint64)))
        return [r for r in rows if r not in seen]

    def batch_of(rows):
        a = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
        b = pa.array([None if r[1] is None else r[1] - (1 << 64) if r[1] >= 1 << 63 else r[1] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b], names=["a", "b"])

    for batch in batches:
        bucket, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        fp = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(fp))
        out: list[tuple[int, int | None]] = []
        multi = np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
        for g in multi.tolist():
            s, e = int(starts[g]), int(ends[g])
            key = int(bucket[s])
            if key != held_key:
                if held_key is not None:
                    fresh = close()
                    seen.update(fresh)
                    out += fresh
                held_key, held, dense = key, [], False
            new = fp[s:e].tolist()
            if dense or len(held) + len(new) > DENSE:
                if not dense:
                    fresh = [(x, None) for x in held if (x, None) not in seen]
                    seen.update(fresh)
                    out += fresh
                    held = []
                dense = True
                fresh = [(x, None) for x in new if (x, None) not in seen]
                seen.update(fresh)
                out += fresh
            else:
                held += new
        if len(seen) > 500_000:
            seen.clear()
        if out:
            yield batch_of(out)
    if held_key is not None and (fresh := close()):
        yield batch_of(fresh)


def _ball(batches):
    """(bucket, fp): all 2081 variants of whole fingerprints within 2 bits."""
    one = [1 << b for b in range(64)]
    masks = np.array([0, *one, *[a | b for a, b in combinations(one, 2)]], dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 256):
            part = fp[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["bucket", "fp"])


def ball_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between whole fingerprints that connect exactly what 2 + 2 bit balls connect; fps: distinct (fp)."""
    variants = fps.select("fp").mapInArrow(_ball, "bucket long, fp long")
    buckets = variants.groupBy("bucket").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)  # 2081 at most
    return buckets.select(F.explode("m").alias("a"), F.array_min("m").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (fp) exactly as all links of up to RADIUS bits do."""
    variants = fps.select("fp").mapInArrow(_sub_variants, "bucket long, fp long")
    dealt = variants.repartition(F.col("bucket")).sortWithinPartitions("bucket", "fp")
    found = durable(dealt.mapInArrow(_bucket_links, "a long, b long").distinct())
    pairs, dense = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("fp"))
    if dense.limit(1).count():
        pairs = pairs.union(ball_links(dense))
    return pairs


def _least(rows: DataFrame, each: Column) -> DataFrame:
    """``rows`` (.., fp) with ``least``, the least ``each`` of all rows whose fingerprints link up with theirs."""
    nodes = durable(rows.groupBy("fp").agg(F.count("*").alias("w"), F.min(each).alias("first")))
    total = nodes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    part = durable(components(links(nodes)).withColumnRenamed("node", "fp"))
    member = nodes.join(part, "fp", "left").select("fp", "w", "first", F.coalesce("component", "fp").alias("component"))
    lowest = durable(member.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    distinct = lowest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    facts = durable(join_facts(member, lowest, ["component"], "n", distinct, F.col("fp")).select("fp", "w", "least"))
    return join_facts(rows, facts, ["fp"], "w", total, F.xxhash64(*[c for c in rows.columns if c != "fp"]))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs`` (doc_id, text)."""
    out = _least(durable(fingerprints(docs)), F.col("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each group: the one with the least doc_id stays.

    Null ids rank last, and rows of equal id by their addresses. The rows that go are found by their addresses, so texts
    stay where they are (see ``common.meet``).
    """
    rows, names = addressed(docs)
    found = _least(durable(fingerprints(rows, names)), F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), "row0", "row1"))
    gone = found.where((F.col("row0") != F.col("least.row0")) | (F.col("row1") != F.col("least.row1")))
    return meet(rows, gone.select(*[F.col(f"row{k}").alias(n) for k, n in enumerate(names)]), names, "left_anti").drop(*names)
