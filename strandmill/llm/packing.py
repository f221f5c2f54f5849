"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document is cut into whole sequences and a remainder. The remainder is cut into pieces of exactly capacity / k tokens,
the largest first, until less than ``CRUMB`` tokens are left, which stay whole. A piece is of class k = capacity // length,
and a bin of class k takes k pieces: a fixed count, so workers fill the bins of each class on their own, without any
exchange. What a worker has left over, less than one bin a class, it lays end to end, small pieces first, and cuts at the
capacity; so less than one sequence a worker is left, in few pieces. These go through two more rounds, in shares of
``SHARE`` workers and then of ``SHARE`` shares, each laid end to end and cut alike; the last sequence of the last round is
split into powers of two, which need no padding.

Defined cases: a null text counts as empty; the empty text is the end token alone. Rows with equal doc_id are packed each
for itself. A null doc_id is returned as null. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import durable, small_batches

CAPACITY, END_ID, CRUMB, SHARE = 2048, 1, 32, 64
#: Characters of a text that are encoded at once.
LONG = 1 << 18


@lru_cache(maxsize=2)
def _encoder(name: str):
    """Byte-level BPE of tokenizers' file ``name`` by its merge ranks; special tokens' strings are ordinary text."""
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(name.replace(".json", ".tiktoken")), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _four_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def _added(name: str) -> dict[str, int]:
    """The added tokens of tokenizers' file ``name``, which are found in a text before anything else."""
    import public_tokenizers as public

    found = json.load(open(public.path(name), encoding="utf-8"))["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that take in or look at what is beside them: {odd}")
    return {t["content"]: t["id"] for t in found}


@lru_cache(maxsize=4)
def tokenizer(name: str, added: bool = False):
    """text -> its ids as little-endian uint32 bytes; ``added``: the file's added tokens in a text give their own ids.

    The pre-tokens of the vocabulary begin at every single space between two letters or digits, so texts of over ``LONG``
    characters are encoded in parts that begin at such spaces, which bounds memory.
    """
    encode, cut = _encoder(name), re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

    def ids(text: str) -> bytes:
        if len(text) <= LONG:
            return _four_bytes(encode(text))
        parts, at = [], 0
        while at < len(text):
            found = cut.search(text, at + LONG)
            stop = found.start() if found else len(text)
            parts.append(_four_bytes(encode(text[at:stop])))
            at = stop
        return b"".join(parts)

    if not added or not (own := {k: _four_bytes([v]) for k, v in _added(name).items()}):
        return ids
    split = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split

    def all_ids(text: str) -> bytes:
        if not any(t in text for t in own):
            return ids(text)
        return b"".join(own[part] if k % 2 else ids(part) for k, part in enumerate(split(text)))

    return all_ids


def harmonic_cuts(length: int, capacity: int = CAPACITY, crumb: int = CRUMB) -> list[tuple[int, int]]:
    """(piece length, class) of a document of ``length`` tokens, in order."""
    out = [(capacity, 1)] * (length // capacity)
    left = length % capacity
    while left >= crumb:
        k = -(-capacity // left)
        while capacity // k > left:
            k += 1
        out.append((capacity // k, k))
        left -= capacity // k
    if left:
        out.append((left, capacity // left))
    return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, bin long, offset long, rest binary"
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("worker", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("rest", pa.binary())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), _FIELDS)], schema=pa.schema(_FIELDS))


def lay(pieces: list[tuple], serial: int, final: bool = False):
    """Lay pieces (doc_id, start, length, doc_tokens, ids) end to end and cut them at the capacity.

    Gives (doc_id, start, length, ids_crc32, doc_tokens, bin, offset, rest), bins numbered from ``serial`` on; the pieces of
    the last sequence, if it isn't full, have no bin and keep their ids in rest, or, if ``final``, are cut into powers of two.
    """
    total = sum(p[2] for p in pieces)
    edges = list(range(CAPACITY, total + 1, CAPACITY))
    left = total % CAPACITY
    for b in range(CAPACITY.bit_length() - 1, -1, -1):
        if final and left >> b & 1:
            edges.append((edges[-1] if edges else 0) + (1 << b))
    pos = n = begin = 0
    for doc_id, start, length, tokens, ids in pieces:
        at = 0
        while at < length:
            stop = edges[n] if n < len(edges) else total + 1
            size = min(length - at, stop - pos)
            part = ids[4 * at : 4 * (at + size)]
            full = n < len(edges)
            yield doc_id, start + at, size, zlib.crc32(part), tokens, serial + n if full else None, pos - begin if full else None, None if full else part
            at, pos = at + size, pos + size
            if pos == stop:
                n, begin = n + 1, pos


def _pieces(name: str, added: bool):
    """Pieces with the bins that this worker fills; ``rest`` holds the ids of the pieces of its last, unfilled sequence."""

    def run(batches):
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        encode, end = tokenizer(name, added), np.array([END_ID], "<u4").tobytes()
        open_bins: dict[int, list] = {}
        serial = 0
        for batch in batches:
            rows = []
            for doc_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(scalar.as_py() or "") + end
                at, tokens = 0, len(ids) // 4
                for length, k in harmonic_cuts(tokens):
                    held = open_bins.setdefault(k, [])
                    held.append((doc_id, at, length, tokens, ids[4 * at : 4 * (at + length)]))
                    at += length
                    if len(held) == k:
                        offset = 0
                        for d, start, n, t, part in held:
                            rows.append((d, start, n, zlib.crc32(part), t, worker, serial, offset, None))
                            offset += n
                        serial += 1
                        held.clear()
                if len(rows) >= 8192:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        left = [p for _, held in sorted(open_bins.items(), reverse=True) for p in held]
        if left:
            yield _batch([(*r[:5], worker, *r[5:]) for r in lay(left, serial)])

    return run


def _relay(final: bool):
    """A round over the unfilled sequences of a share; ``worker`` becomes the share's number."""

    def run(key, table):
        rows = table.sort_by([("worker", "ascending"), ("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist()
        out = list(lay([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["rest"]) for r in rows], 0, final))
        return pa.Table.from_batches([_batch([(*r[:5], key[0].as_py(), *r[5:]) for r in out])])

    return run


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", added: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    ``added``: strings of the file's added tokens give these tokens' ids, as tokenizers does unless told otherwise; else
    they are ordinary text.

    Each round is written to the checkpoint folder, so that a worker's bins are the same whoever reads them. A share holds
    less than one sequence for each of its ``SHARE`` members, whatever the input.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rounds = [durable(source.mapInArrow(_pieces(name, added), PIECE))]
    for final in (False, True):
        left = rounds[-1].where("bin is null").withColumn("share", F.expr(f"worker div {SHARE}"))
        rounds.append(durable(left.groupBy("share").applyInArrow(_relay(final), PIECE)))
    out = []
    for k, each in enumerate(rounds):  # 2 bits for the round, 24 for the worker or share, 36 for its bin
        id_ = F.lit(k).cast("long")
        for col, width in (("worker", 24), ("bin", 36)):
            id_ = F.shiftleft(id_, width).bitwiseOR(F.col(col))
        out.append(each.where("bin is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", id_.alias("sequence_id"), "offset"))
    return out[0].unionAll(out[1]).unionAll(out[2])


def padding(packed: DataFrame) -> DataFrame:
    """(sequences, tokens, padded): padded counts sequences at 2048 unless their length is a power of two."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, F.col("n")).otherwise(F.lit(CAPACITY))
    return fill.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), (F.sum(whole) - F.sum("n")).alias("padded"))
