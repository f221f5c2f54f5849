"""Substring deduplication by sliding sentence spans.

Every run of ``RUN`` consecutive sentences is hashed; equal runs are found by one global aggregation, and every occurrence
but the first (by doc_id, then row, then place) is non-first. What a non-first run covers is removed, however short. Sentences
end after words that end in . ! or ?, and at line breaks; so a single line of a few clipped sentences, which many unrelated
documents may share, is no run.

A shared passage need not begin and end with sentences, and sentences can be long. So there are runs of clauses too: a
clause ends where a sentence does, and after the word with the least hash of any ``WINDOW`` consecutive words, so that none
has more than ``WINDOW`` words. Whether one ends after a word depends on that word and the ``WINDOW`` - 1 words on either
side of it, on nothing further off. A run of clauses goes from the beginning of any clause (or to the end of any) over
``CLAUSES`` of them or more, until it has ``SPAN`` words, as many as several sentences. Of 50 shared words, which may begin and
end in mid-sentence, the ends from the 8th to the 43rd word fall alike in every copy; the first of them is at the 15th at
the latest and the run from there has 27 words at most. So any 50 shared words hold a whole run. Up to 15 words at either
edge of such a passage may stay.

A run is its words; its identity is a hash of 126 bits or so (two sums mod 2^64 of hashes of its words times powers of two
odd bases), computed by prefix sums over whole Arrow buffers, without a Python step for each word. The runs are hashed
twice and never written: once for the counts of one half of their hashes, and once for those that these counts don't rule
out; only the whole hash decides.

Defined cases: null and empty texts have no sentences. A text of fewer than RUN sentences has runs of clauses only. Words
are compared lower-cased (A-Z) with white space folded. A null doc_id ranks last, and is returned as null. Rows with equal
doc_id are told apart by their address. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import LOWER_TABLE, addressed, durable, fresh, hot_limit, meet

RUN, CLAUSES, SPAN, WINDOW = 5, 3, 20, 8
#: Bits of the filter of repeated hashes that goes to the workers.
FILTER_BITS = 27
#: Bytes of text that are hashed at once; bounds memory for very long texts.
BLOCK = 1 << 20

_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
_SPACE, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\x0b\x0c\r ", b".!?"))
_VALUE = np.random.default_rng(20240307).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bases of the sums: of a word's bytes, and of a run's words twice. 3 mod 4, so that base - 1 has a single factor of two.
_BASES = (0x9E3779B97F4A7C17, 0xD1342543DE82EF97, 0xAF251AF3B0F025B7)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` or more powers of ``base`` and of its inverse mod 2^64, from the 0th on."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(1 << 16, 1 << int(size - 1).bit_length()), b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of texts that lie end to end in ``data``, cut at ``bounds``; BLOCK bytes at a time."""
    found, at, n = [], 0, len(data)
    while at < n:
        stop = min(n, at + BLOCK)
        if stop < n:  # only a text that is longer than a block comes here: cut it behind white space
            gap = np.flatnonzero(_SPACE[data[at:stop]])
            while not len(gap) and stop < n:
                at_, stop = stop, min(n, stop + BLOCK)
                gap = np.flatnonzero(_SPACE[data[at_:stop]]) + (at_ - at)
            stop = at + int(gap[-1]) + 1 if len(gap) and stop < n else stop
        part = data[at:stop]
        space, mark = _SPACE[part], _MARK[part]
        begin, end = ~space, ~space
        edge = space[:-1] | (mark[:-1] & ~mark[1:])
        begin[1:] &= edge
        end[:-1] &= space[1:] | (mark[:-1] & ~mark[1:])
        inner = bounds[(bounds > at) & (bounds < stop)] - at
        begin[inner] = ~space[inner]
        end[inner - 1] = ~space[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, back = _powers(_BASES[0], len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[part] * power[: len(part)], out=sums[1:])
        found.append((starts + at, ends + at, _mix((sums[ends] - sums[starts]) * back[starts], 0)))
        at = stop
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


class _Block:
    """Sentences, clauses and runs of some texts; ``data`` is their lower-cased UTF-8, ``bounds`` where each begins, and the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.starts, ends, self.hashes = _words(data, bounds)
        n = len(self.starts)
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        self.ends = np.append(self.starts[1:], 0)[:n]  # with the white space behind
        final = np.append(self.doc[1:] != self.doc[:-1], True) if n else np.zeros(0, bool)
        self.ends[final] = bounds[self.doc[final] + 1]
        breaks = np.flatnonzero(data == 10)
        marks = _MARK[data[ends - 1]] | (np.searchsorted(breaks, ends) < np.searchsorted(breaks, self.ends))
        stops = marks | final
        if n >= WINDOW:
            least, place = np.where(marks, 0, (self.hashes >> np.uint64(1)) + np.uint64(1)), np.arange(n)
            step = 1
            while step < WINDOW:  # the least of 2, 4, 8 consecutive words; the last of those tied
                right = least[step:] <= least[:-step]
                place = np.where(right, place[step:], place[:-step])
                least = np.where(right, least[step:], least[:-step])
                step *= 2
            stops[place[self.doc[: len(place)] == self.doc[WINDOW - 1 :]]] = True
        self.clause_end = np.flatnonzero(stops)
        self.sentence_end = np.flatnonzero(marks | final)

    def _runs(self, ends: np.ndarray, parts: int, least: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first words, last words) of the shortest runs of ``parts`` parts or more, and ``least`` words or more, from (or to) each part."""
        n = len(ends)
        starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        place = np.arange(n)
        if backward:
            first = np.minimum(place - parts + 1, np.searchsorted(starts, ends - (least - 1), side="right") - 1)
            good = (first >= 0) & (self.doc[starts[np.maximum(first, 0)]] == self.doc[ends])
            return starts[first[good]], ends[good]
        last = np.maximum(place + parts - 1, np.searchsorted(ends, starts + (least - 1)))
        good = (last < n) & (self.doc[ends[np.minimum(last, n - 1)]] == self.doc[starts])
        return starts[good], ends[last[good]]

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, last words) of the runs of sentences and of those from each clause on, each once."""
        a, b = self._runs(self.clause_end, CLAUSES, SPAN)
        c, d = self._runs(self.sentence_end, RUN, 1)
        if not len(c):
            return a, b
        spot = np.minimum(np.searchsorted(a, c), max(len(a) - 1, 0))
        new = (a[spot] != c) | (b[spot] != d) if len(a) else np.ones(len(c), bool)
        return np.concatenate([a, c[new]]), np.concatenate([b, d[new]])

    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, last words) of the runs up to each clause."""
        return self._runs(self.clause_end, CLAUSES, SPAN, backward=True)

    def hashed(self, first: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
        """One half (0 or 1) of the hashes of runs, signed."""
        power, back = _powers(_BASES[1 + half], len(self.hashes) + 1)
        sums = np.empty(len(self.hashes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_mix(self.hashes, 0x5851F42D4C957F2D * (half + 1)) * power[: len(self.hashes)], out=sums[1:])
        return _mix((sums[last + 1] - sums[first]) * back[first], 0).view(np.int64)

    def points(self, places: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Byte places as code points of their texts."""
        tails = np.flatnonzero((self.data & 0xC0) == 0x80)
        begin = self.bounds[doc]
        return (places - begin - (np.searchsorted(tails, places) - np.searchsorted(tails, begin))).astype(np.int32)

    def begins(self, first: np.ndarray) -> np.ndarray:
        """Byte places at which parts that begin with words ``first`` begin: with a text's first word, the text itself."""
        opens = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])[first]
        return np.where(opens, self.bounds[self.doc[first]], self.starts[first])


def _blocks(text: pa.Array):
    """(number of the first text, block) of consecutive texts of about BLOCK bytes; a longer text is a block of its own."""
    text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, where, raw = text.buffers()
    places = np.frombuffer(where, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(places, places[at] + BLOCK, side="right")) - 1)
        if places[stop] > places[at]:
            yield at, _Block(_LOWER[data[places[at] : places[stop]]], places[at : stop + 1] - places[at])
        at = stop


def _block_of(text: str | None) -> _Block:
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return _Block(data, np.array([0, len(data)]))


def _spans(text: str | None, ends) -> list[tuple[int, int]]:
    block = _block_of(text)
    last = ends(block)
    if not len(last):
        return []
    places = [0, *block.points(block.ends[last], block.doc[last]).tolist()]
    return list(zip(places, places[1:]))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) code points of the sentences of ``text``, without gaps."""
    return _spans(text, lambda b: b.sentence_end)


def clauses(text: str | None) -> list[tuple[int, int]]:
    """(start, end) code points of the clauses of ``text``, without gaps."""
    return _spans(text, lambda b: b.clause_end)


def _hashes(batches):
    """One half of the hash of every run of sentences, and from every clause on."""
    for batch in batches:
        for _, block in _blocks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(block.hashed(*block.forward(), 0))], names=["via"])


RUNS = "file long, at long, doc_id long, start int, end int, hash long, other long"


def _runs(seen, only: np.ndarray | None = None):
    """RUNS: the runs whose counted hash, or that of the run that begins where they do, is in the filter, and in ``only`` if given.

    A run up to a clause holds the whole run from its beginning on, so it can't be repeated more often than that one.
    """

    def run(batches):
        bits = np.frombuffer(seen.value, np.uint8)
        names = [c.split()[0] for c in RUNS.split(", ")]
        for batch in batches:
            for at, block in _blocks(batch.column(3)):
                first, last = block.forward()
                counted = block.hashed(first, last, 0)
                spot = counted & ((1 << FILTER_BITS) - 1)
                may = bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 != 0
                if only is not None:
                    may &= np.isin(counted, only)
                if not may.any():
                    continue
                a, b = first[may], last[may]
                c, d = block.backward()
                hit = np.isin(c, a) & ~np.isin(c << 32 | d, a << 32 | b)
                a, b = np.concatenate([a, c[hit]]), np.concatenate([b, d[hit]])
                doc = block.doc[a]
                rows = pa.array(at + doc)
                cols = [batch.column(k).take(rows) for k in range(3)]
                cols += [pa.array(block.points(p, doc)) for p in (block.begins(a), block.ends[b])]
                cols += [pa.array(block.hashed(a, b, half)) for half in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _filter(hashes: DataFrame) -> bytes:
    """A bitmap of the low FILTER_BITS of ``hashes`` (via), of a fixed size; what it lets through in vain has no like.

    It comes to the driver in pieces of 4,096 bits, so what comes is no more than the bitmap, however many hashes there are.
    """
    low = (1 << FILTER_BITS) - 1
    cell = hashes.select(F.expr(f"shiftright(via & {low}L, 6)").alias("cell"), F.expr("shiftleft(1L, cast(via & 63 as int))").alias("bit"))
    words = cell.groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    entries = F.collect_list(F.struct(F.expr("cast(cell & 63 as int)").alias("at"), "bits"))
    pieces = words.groupBy(F.shiftright("cell", 6).alias("piece")).agg(F.map_from_entries(entries).alias("words"))
    found = pieces.select("piece", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("words", i), F.lit(0).cast("long"))).alias("words")).toArrow()
    out = np.zeros((1 << (FILTER_BITS - 12), 64), "<i8")
    if found.num_rows:
        out[found.column("piece").to_numpy()] = found.column("words").combine_chunks().flatten().to_numpy().reshape(-1, 64)
    return out.tobytes()


def _covered(rows: DataFrame) -> DataFrame:
    """(file, at, doc_id, start, end, first_doc_id) of addressed rows (file, at, doc_id, text).

    Runs that may be repeated meet by their hash, once, in a window of bounded size. Hot ones don't meet: their first places
    come from an aggregation and are broadcast, and they are spread.
    """
    twice = durable(rows.select("text").mapInArrow(_hashes, "via long").groupBy("via").agg(F.count("*").alias("w")).where("w > 1"))
    limit = hot_limit(twice.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    hot = np.array([r[0] for r in twice.where(F.col("w") > limit).select("via").collect()], np.int64)
    seen = rows.sparkSession.sparkContext.broadcast(_filter(twice))
    own = rows.select("file", "at", "doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), *["doc_id", "file", "at", "start"])
    often = own.mapInArrow(_runs(seen, hot), RUNS).groupBy("hash", "other").agg(F.min(order).alias("least"), F.count("*").alias("w")).where(F.col("w") > limit)
    often = durable(often.select("hash", "other", "least")) if len(hot) else None
    may = own.mapInArrow(_runs(seen), RUNS)
    if often is None:
        may = may.withColumns({"salt": F.lit(0), "known": F.lit(False), "is_least": F.lit(False), "least_id": F.lit(None).cast("long")})
    else:
        same = (F.col("file") == F.col("least.file")) & (F.col("at") == F.col("least.at")) & (F.col("start") == F.col("least.start"))
        known = F.col("least").isNotNull()
        salt = F.when(known, F.pmod(F.xxhash64("file", "at", "start"), F.lit(1 << 16)).cast("int") + 1).otherwise(F.lit(0))
        may = may.join(F.broadcast(often), ["hash", "other"], "left").withColumns({"salt": salt, "known": known, "is_least": same, "least_id": F.col("least.doc_id")}).drop("least")
    alike = Window.partitionBy("hash", "other", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "file", "at", "start")
    ranked = may.withColumns({"nth": F.row_number().over(alike), "first": F.first("doc_id").over(alike)})
    later = ranked.where(F.when(F.col("known"), ~F.col("is_least")).otherwise(F.col("nth") > 1))
    first = F.when(F.col("known"), F.col("least_id")).otherwise(F.col("first"))
    spans = later.select("file", "at", "doc_id", F.struct("start", "end", first.alias("first")).alias("s"))
    grouped = spans.groupBy("file", "at", "doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most two for each clause of a text
    return grouped.mapInArrow(_merge, "file long, at long, doc_id long, start int, end int, first_doc_id long")


def _merge(batches):
    """Stretches that overlap or adjoin, from lists of spans by start; the first span names the first document."""
    names = ["file", "at", "doc_id", "start", "end", "first_doc_id"]
    for batch in batches:
        lists = batch.column(3)
        spans, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        start, end = (spans.field(k).to_numpy() for k in range(2))
        reach = np.maximum.accumulate(end.astype(np.int64) + (owner << 32))  # a later list's ends are all greater
        opens = np.flatnonzero(np.concatenate([[True], start[1:] + (owner[1:].astype(np.int64) << 32) > reach[:-1]]))
        closes = np.append(opens[1:], len(start)) - 1
        rows = pa.array(owner[opens])
        ends = (reach[closes] - (owner[closes] << 32)).astype(np.int32)
        own = [batch.column(k).take(rows) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(start[opens]), pa.array(ends), spans.field(2).take(pa.array(opens))], names=names)


def _own(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, ("file", "at"))], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(file, at, doc_id, start, end, first_doc_id): maximal stretches of ``docs`` (doc_id, text) that non-first runs cover.

    file and at are the row's address; start and end are code points, end exclusive.
    """
    return _covered(_own(*addressed(docs)))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered stretches cut from text; other columns and rows are unchanged."""
    rows, names = addressed(docs)
    text, spans = fresh(rows, "whole", "cuts")
    cuts = _covered(_own(rows, names)).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    cuts = durable(cuts.select(F.col("file").alias(names[0]), F.col("at").alias(names[1]), spans))
    whole = meet(rows, cuts.select(*names), names, "left_anti")
    cut = meet(rows, cuts.select(*names), names, "left_semi").withColumnRenamed("text", text).join(cuts, names)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))
    rest = F.aggregate(
        spans,
        zero,
        lambda acc, c: F.struct(c["end"].alias("at"), F.concat(acc["kept"], F.array(F.col(text).substr(acc["at"] + 1, c["start"] - acc["at"]))).alias("kept")),
        lambda acc: F.concat(F.array_join(acc["kept"], ""), F.col(text).substr(acc["at"] + 1, F.length(text))),
    )
    return whole.drop(*names).unionByName(cut.withColumn("text", rest).drop(text, spans, *names))
