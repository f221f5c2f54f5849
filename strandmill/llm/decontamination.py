"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are word sequences. The CGK walk reads a window through a random stride of 0 or 1 a step, which depends
on the step and the word, and so maps edit distance to Hamming distance with high probability. Each of ``WALKS`` walks
gives ``TABLES`` samples of ``SAMPLE`` positions of the embedding as hash keys; windows and items that share any key are
verified by their exact word edit distance, the item against the best-placed stretch of the text near the window. With
these figures a window at the full radius of 0.2 edits a word is found with probability 0.9 or more (measured in
tests/llm/test_text_operators.py and test_advice_decontamination.py), an exact one always.

Windows start at every word and have the length of a size class of items (classes grow by a quarter; an item of up to
``WHOLE`` words enters with its first words, as many as its class has). A longer item enters with several heads of one
of the classes in ``HEADS``, which lie side by side over all of it, so the walks never get longer; any head may yield
the candidate. Of k heads one has at most a k-th of the item's edits. One edit breaks two word pairs at most, so a
window within d edits of a head keeps all but 2 d of its pairs; windows with fewer pairs that occur in any item are not
embedded. This drops no match within that figure. All stretches of a text that may hold one item are verified together
where they overlap.

Items are a stated query set: they go to the workers in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES``
bytes, one pass over the texts each, with tables that the driver has built and that the block bounds.

Defined cases: words are runs of ASCII letters and digits and of any non-ASCII characters, lower-cased. Null and blank
texts match nothing, and null and blank items are not looked for. Items of fewer than five words allow no edit: they match
where they occur word for word. A null doc_id is returned as null. Items with equal text each give their own rows. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import addressed, meet

SIMILARITY = 0.8
WALKS, TABLES, SAMPLE = 6, 12, 3
WHOLE, HEADS = 96, (41, 51, 63, 78)
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16_000_000
#: Windows embedded at once.
CHUNK = 1 << 14

_NOT_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_NOT_WORD).split()


def size_class(n: int) -> int:
    """The largest class length of n or less: 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, ..."""
    size = 1
    while (step := max(size + 1, size * 5 // 4)) <= n:
        size = step
    return size


def allowed(n: int) -> int:
    """Edits within the similarity for an item of n words."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def heads_of(n: int) -> tuple[int, list[int]]:
    """(size, starts) of the heads of an item of n words; a long one's leave as few words out as the sizes allow."""
    if n <= WHOLE:
        return size_class(n), [0]
    size = max(HEADS, key=lambda h: (n // h * h, h))
    count = n // size
    return size, [k * (n - size) // (count - 1) for k in range(count)]


def _constants(walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([71, walk])
    return rng.integers(0, 1 << 63, 4096, dtype=np.uint64)[:steps] * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 4096, dtype=np.uint64)[:steps]


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of each row of word numbers, to twice its length; -1 past the end."""
    count, size = windows.shape
    steps = 2 * size
    mul, add = _constants(walk, steps)
    padded = np.concatenate([windows, np.full((count, 1), -1, windows.dtype)], axis=1)
    flat, base, at = padded.ravel(), np.arange(count) * (size + 1), np.zeros(count, np.int64)
    out = np.empty((steps, count), np.int64)
    for j in range(steps):
        word = flat[base + at]
        out[j] = word
        stride = ((word.astype(np.uint64) + np.uint64(7)) * mul[j] + add[j]) >> np.uint64(63)
        at = np.minimum(at + stride.astype(np.int64), size)
    return out


def keys(windows: np.ndarray, walk: int) -> np.ndarray:
    """(TABLES, rows) hash keys of one walk."""
    image = embed(windows, walk).astype(np.uint64)
    rng = np.random.default_rng([72, walk, windows.shape[1]])
    out = np.empty((TABLES, windows.shape[0]), np.uint64)
    for t in range(TABLES):
        key = np.full(windows.shape[0], 1 + walk * TABLES + t, np.uint64)
        for p in rng.choice(image.shape[0], min(SAMPLE, image.shape[0]), replace=False):
            key = (key ^ image[p]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[t] = key
    return out


def infix_edits(item, text) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` with the fewest word edits to ``item``; the first, then longest-starting, if tied."""
    t = np.asarray(text, np.int64)
    n = len(t)
    dist, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    span = np.arange(n + 1)
    for word in item:
        take = np.empty(n + 1, np.int64)
        begin = np.empty(n + 1, np.int64)
        take[0], begin[0] = dist[0] + 1, start[0]
        swap = dist[:-1] + (t != word)
        drop = dist[1:] + 1
        take[1:] = np.minimum(swap, drop)
        begin[1:] = np.where(swap <= drop, start[:-1], start[1:])
        low = take - span  # a run of inserted words costs one each: a prefix minimum
        best = np.minimum.accumulate(low)
        where = np.maximum.accumulate(np.where(low == best, span, 0))
        dist, start = best + span, begin[where]
    end = int(dist.argmin())
    return int(dist[end]), int(start[end]), end


class ItemIndex:
    """LSH tables of a block of items [(item_id, text)]; arrays, so that it can be broadcast."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        by_class = defaultdict(list)
        for item_id, text in items:
            if words := words_of(text):
                size, starts = heads_of(len(words))
                by_class[size] += [(len(self.items), at) for at in starts]
                self.items.append((item_id, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)))
        self.base = len(self.number) + 1
        pairs = [item[:-1] * self.base + item[1:] for _, item in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.classes = []
        for size, members in sorted(by_class.items()):
            heads = np.array([self.items[m][1][at : at + size] for m, at in members], dtype=np.int64)
            tables = []
            for walk in range(WALKS):
                rows = keys(heads, walk)
                order = np.argsort(rows, axis=None, kind="stable")
                tables.append((rows.ravel()[order], (order % len(members)).astype(np.int32)))
            most = max(allowed(n) // len(heads_of(n)[1]) for n in {len(self.items[m][1]) for m, _ in members})
            self.classes.append((size, max(1, size - 1 - 2 * most), np.array(members, np.int64), tables, np.unique(heads[:, 0])))

    def matches(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, edits), the best stretch for each text and item."""
        get = self.number.get
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.array(list(map(get, chain.from_iterable(texts), repeat(0))), dtype=np.int64)
        if not len(flat) or not self.items:
            return []
        ends = np.cumsum(lengths)
        known = np.zeros(len(flat) + 1, np.int32)
        if len(self.pairs):
            both = np.flatnonzero((flat[:-1] != 0) & (flat[1:] != 0))
            codes = flat[both] * self.base + flat[both + 1]
            spot = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            known[both[self.pairs[spot] == codes] + 1] = 1
        known[ends[lengths > 0]] = 0  # the last word of a text starts no pair
        known = np.cumsum(known, dtype=np.int32)
        owner_end = np.repeat(ends, lengths)
        pairs: set[tuple[int, int, int]] = set()
        for size, least, members, tables, first in self.classes:
            if size == 1:  # no pairs to go by
                starts = np.flatnonzero(np.isin(flat, first))
            else:
                padded = np.concatenate([known, np.full(size, known[-1], np.int32)])
                starts = np.flatnonzero(padded[size - 1 : size - 1 + len(flat)] - known[:-1] >= least)
                starts = starts[known[np.minimum(starts + size - 1, owner_end[starts])] - known[starts] >= least]
            for at in range(0, len(starts), CHUNK):
                part = starts[at : at + CHUNK]
                grid = part[:, None] + np.arange(size)[None, :]
                windows = np.where(grid < owner_end[part][:, None], flat[np.minimum(grid, len(flat) - 1)], -1)
                for walk, (known_keys, owner) in enumerate(tables):
                    rows = keys(windows, walk)
                    lo = np.searchsorted(known_keys, rows)
                    for t, h in np.argwhere(known_keys[np.minimum(lo, len(known_keys) - 1)] == rows).tolist():
                        hi = np.searchsorted(known_keys, rows[t, h], side="right")
                        pairs.update((int(part[h]), *head) for head in members[owner[lo[t, h] : hi]].tolist())
        spans = defaultdict(list)
        for s, m, at in pairs:
            doc, n = int(np.searchsorted(ends, s, side="right")), len(self.items[m][1])
            room = allowed(n) * (1 if n <= WHOLE else 2)  # words before a head may be missing or inserted
            spans[doc, m].append((max(int(ends[doc] - lengths[doc]), s - at - room), min(int(ends[doc]), s - at + n + room)))
        out: dict[tuple[int, int], tuple] = {}
        here = np.zeros(self.base, bool)
        for (doc, m), each in spans.items():
            item = self.items[m][1]
            room = allowed(len(item))
            left = int(ends[doc] - lengths[doc])
            joined: list[list[int]] = []
            for lo, hi in sorted(each):
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            for lo, hi in joined:
                stretch = flat[lo:hi]
                here[stretch] = True
                absent = len(item) - np.count_nonzero(here[item])
                here[stretch] = False
                if absent > room:
                    continue  # each absent word is an edit
                edits, a, b = infix_edits(item, stretch)
                if edits <= room and ((doc, m) not in out or edits < out[doc, m][2]):
                    out[doc, m] = (lo + a - left, lo + b - left, edits)
                    if not edits:
                        break  # the first exact match stands
        return [(doc, m, a, b, edits) for (doc, m), (a, b, edits) in sorted(out.items())]


MATCH = "item_id long, start_word int, end_word int, edits int, similarity double"


def _matcher(block):
    def run(batches):
        index = block.value
        names, kinds = ["item_id", "start_word", "end_word", "edits", "similarity"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            n, texts = batch.num_rows, batch.column(batch.num_columns - 1)
            rows, at, size = [], 0, 0
            held: list[list[bytes]] = []
            for k in range(n + 1):
                if k < n:
                    held.append(words_of(texts[k].as_py()))
                    size += len(held[-1])
                if size > 400_000 or k == n:
                    for doc, m, a, b, edits in index.matches(held) if held else ():
                        item_id, item = index.items[m]
                        rows.append((at + doc, item_id, a, b, edits, round(1 - edits / len(item), 6)))
                    at, size, held = at + len(held), 0, []
            if rows:
                where, *cols = zip(*rows)
                own = [c.take(pa.array(where)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*batch.schema.names[:-1], *names])

    return run


def _blocks(items: DataFrame):
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _contamination(own: DataFrame, items: DataFrame) -> DataFrame:
    """Matches of ``own`` (long columns, and text as the last), with its other columns in front."""
    schema = "".join(f"{c} long, " for c in own.columns[:-1]) + MATCH
    out = own.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        out = out.unionAll(own.mapInArrow(_matcher(own.sparkSession.sparkContext.broadcast(ItemIndex(block))), schema))
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item of which the document holds a near copy: its best stretch, in words."""
    return _contamination(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a match.

    The rows that go are found by their addresses, so null and repeated ids don't matter, and texts stay where they are
    (see ``common.meet``).
    """
    rows, names = addressed(docs)
    own = rows.select(*[F.col(n).alias(f"row{k}") for k, n in enumerate(names)], F.col("text").cast("string").alias("text"))
    bad = _contamination(own, items).select(*[F.col(f"row{k}").alias(n) for k, n in enumerate(names)]).distinct()
    return meet(rows, bad, names, "left_anti").drop(*names)
