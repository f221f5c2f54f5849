"""Delta coding of label maps, palettes and packets.

A segment of ``interval`` frames is coded by itself: its first frame holds all labelled pixels, the others the pixels that
changed, label 0 for one that went away. So segments decode in parallel. A key packet (a whole picture) also starts a segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.windows import frame_window

INTERVAL, WIDTH = 30, 8


def _segment(interval: int) -> Column:
    return F.floor(F.col("frame_idx") / interval).cast("long")


def delta_encode(frames: DataFrame, interval: int = INTERVAL, width: int = WIDTH) -> DataFrame:
    """(video_id, frame_idx, y, x, label) triples of (video_id, frame_idx, labels)."""
    before = F.lag("labels").over(frame_window("segment"))
    zeros = F.transform("labels", lambda _: F.lit(0))
    pairs = frames.withColumn("segment", _segment(interval)).withColumn("prev", F.coalesce(before, zeros))
    each = pairs.select("video_id", "frame_idx", F.posexplode(F.arrays_zip("labels", "prev")).alias("pos", "p")).where("p.labels <> p.prev")
    return each.select("video_id", "frame_idx", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), F.col("p.labels").alias("label"))


def delta_decode(triples: DataFrame, frames: DataFrame, height: int = WIDTH, width: int = WIDTH, interval: int = INTERVAL) -> DataFrame:
    """(video_id, frame_idx, labels) for each of ``frames`` (video_id, frame_idx): the last label of each pixel in the segment, or 0.

    Segments decode on their own, from the changes alone; a task holds one label map and what it gives out.
    """
    kind = frames.schema["frame_idx"].dataType.simpleString()
    changes = triples.select("video_id", F.col("frame_idx").cast("long").alias("at"), (F.col("y") * width + F.col("x")).cast("int").alias("pos"), F.col("label").cast("int").alias("label"), _segment(interval).alias("segment"))
    wanted = frames.select("video_id", F.col("frame_idx").cast("long").alias("at"), F.lit(-1).alias("pos"), F.lit(0).alias("label"), _segment(interval).alias("segment"))
    schema = pa.schema([("video_id", pa.string()), ("at", pa.int64()), ("labels", pa.list_(pa.int32()))])

    def decode(rows: pa.Table) -> pa.Table:
        at, pos, label = (rows.column(c).to_numpy() for c in ("at", "pos", "label"))
        order = np.lexsort((-pos, at))  # a frame's own changes come before its row with pos -1
        at, pos, label = at[order], pos[order], label[order]
        now, done, out = np.zeros(height * width, np.int32), 0, []
        for stop in np.flatnonzero(pos < 0).tolist():
            now[pos[done:stop]] = label[done:stop]
            done = stop + 1
            out.append(now.copy())
        ends = np.arange(len(out) + 1, dtype=np.int32) * (height * width)
        labels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else now[:0]))
        return pa.Table.from_arrays([rows.column("video_id")[:1].combine_chunks().take(pa.array(np.zeros(len(out), np.int64))), pa.array(at[pos < 0]), labels], schema=schema)

    found = changes.unionAll(wanted).groupBy("video_id", "segment").applyInArrow(decode, "video_id string, at long, labels array<int>")
    return found.select("video_id", F.col("at").cast(kind).alias("frame_idx"), "labels")


def _uint16(value: Column) -> Column:
    """Four hex digits, low byte first."""
    h = F.lpad(F.hex(value.cast("long")), 4, "0")
    return F.concat(h.substr(3, 2), h.substr(1, 2))


def edge_packets(triples: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, payload): tag E and three unsigned 16-bit numbers a pixel, in pixel order; one row a frame."""
    one = F.concat(_uint16(F.col("y")), _uint16(F.col("x")), _uint16(F.col("label")))
    lists = triples.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("y", "x", one.alias("h")))).alias("t"))
    body = F.coalesce(F.array_join(F.transform("t", lambda x: x["h"]), ""), F.lit(""))
    return frames.select("video_id", "frame_idx").join(lists, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.unhex(F.concat(F.lit("45"), body)).alias("payload"))


def key_packets(pictures: DataFrame, coded: str = "picture") -> DataFrame:
    """(video_id, frame_idx, payload): tag K and the coded picture, as a codec outside made it."""
    return pictures.select("video_id", "frame_idx", F.concat(F.lit(b"K"), F.col(coded)).alias("payload"))


def unpack_packets(packets: DataFrame) -> DataFrame:
    """(video_id, frame_idx, tag, y, x, label, picture): a row for each pixel of an edge packet, or one for a key packet.

    An empty payload is an edge packet without pixels. Any other tag is an error.
    """
    head, size = F.hex(F.expr("substring(payload, 1, 1)")), F.octet_length("payload")
    tag = F.when((size == 0) | (head == "45"), F.lit("E")).when(head == "4B", F.lit("K"))
    tag = F.coalesce(tag, F.raise_error(F.concat(F.lit("unknown packet tag "), head)).cast("string"))
    n = F.when(F.col("tag") == "E", F.floor(F.greatest(F.lit(0), size - 1) / 6).cast("int")).otherwise(F.lit(0))
    # a binary's substring costs the same wherever it begins
    value = lambda k: f"cast(conv(hex(concat(substring(payload, 6 * i + {2 * k + 3}, 1), substring(payload, 6 * i + {2 * k + 2}, 1))), 16, 10) as int)"
    pixels = F.expr(f"CASE WHEN n > 0 THEN transform(sequence(0, n - 1), i -> named_struct('y', {value(0)}, 'x', {value(1)}, 'label', {value(2)})) END")
    rows = packets.select("video_id", "frame_idx", "payload", tag.alias("tag")).withColumn("n", n)
    edges = rows.select("video_id", "frame_idx", "tag", F.explode_outer(pixels).alias("p"), F.when(F.col("tag") == "K", F.expr("substring(payload, 2, greatest(octet_length(payload) - 1, 0))")).alias("picture"))
    return edges.select("video_id", "frame_idx", "tag", "p.y", "p.x", "p.label", "picture")


def decode_packets(packets: DataFrame, height: int = WIDTH, width: int = WIDTH, interval: int = INTERVAL) -> DataFrame:
    """(video_id, frame_idx, labels) of the edge packets (video_id, frame_idx, payload), a segment at a time; key packets are passed over.

    The payloads are read as they are; no pixel becomes a row.
    """
    kind = packets.schema["frame_idx"].dataType.simpleString()
    own = packets.select("video_id", F.col("frame_idx").cast("long").alias("at"), "payload", _segment(interval).alias("segment"))
    schema = pa.schema([("video_id", pa.string()), ("at", pa.int64()), ("labels", pa.list_(pa.int32()))])

    def decode(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        now, out, kept = np.zeros(height * width, np.int32), [], []
        for k, payload in enumerate(rows.column("payload").to_pylist()):
            if payload[:1] == b"K":
                continue
            if payload[:1] not in (b"", b"E"):
                raise ValueError(f"unknown packet tag {payload[:1].hex().upper()}")
            y, x, label = np.frombuffer(payload[1 : 1 + max(0, len(payload) - 1) // 6 * 6], "<u2").reshape(-1, 3).T.astype(np.int64)
            now[y * width + x] = label
            out.append(now.copy())
            kept.append(k)
        ends = np.arange(len(out) + 1, dtype=np.int32) * (height * width)
        labels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else now[:0]))
        rows = rows.take(pa.array(kept, pa.int64())).combine_chunks()
        return pa.Table.from_arrays([rows.column("video_id"), rows.column("at"), labels], schema=schema)

    found = own.groupBy("video_id", "segment").applyInArrow(decode, "video_id string, at long, labels array<int>")
    return found.select("video_id", F.col("at").cast(kind).alias("frame_idx"), "labels")


def assign_palette(pixels: DataFrame, palette: list[tuple[float, float, float]]) -> DataFrame:
    """``pixels`` (.., r, g, b) with label = 1 + the nearest palette entry, the first of those tied.

    The palette is a plan-time constant, so no join is made; it does not change from frame to frame.
    """
    far = lambda c: (F.col("r") - float(c[0])) ** 2 + (F.col("g") - float(c[1])) ** 2 + (F.col("b") - float(c[2])) ** 2
    best = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(palette)]))
    return pixels.withColumn("label", best["k"] + 1)


def soft_colours(labelled: DataFrame, palette: list[tuple[float, float, float]]) -> DataFrame:
    """Palette colours of labels, as whole levels; black for label 0."""
    colours = F.array(*[F.array(*[F.lit(int(min(255, max(0, v)))) for v in c]) for c in palette])
    pick = lambda ch: F.when(F.col("label") > 0, F.get(F.get(colours, F.col("label") - 1), F.lit(ch))).otherwise(F.lit(0))
    return labelled.withColumns({"soft_r": pick(0), "soft_g": pick(1), "soft_b": pick(2)})


def fit_palette(pixels: DataFrame, clusters: int = 8, sample: int = 200_000, seed: int = 0) -> list[tuple[float, float, float]]:
    """``clusters`` colours of (r, g, b), padded with black, by k-means on a sample of bounded size; the driver gets the centers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = pixels.count()
    if not n:
        return [(0.0, 0.0, 0.0)] * clusters
    some = pixels if n <= sample else pixels.where(F.pmod(F.xxhash64("r", "g", "b", F.monotonically_increasing_id()), F.lit(n)) < sample)
    rows = VectorAssembler(inputCols=["r", "g", "b"], outputCol="v").transform(some.select(*[F.col(c).cast("double") for c in "rgb"]))
    model = KMeans(featuresCol="v", k=max(2, min(clusters, n)), seed=seed, maxIter=50).fit(rows)
    found = [tuple(float(x) for x in c) for c in model.clusterCenters()][:clusters]
    return found + [(0.0, 0.0, 0.0)] * (clusters - len(found))


def storage_downscale(frames: DataFrame, factor: int, height: int = WIDTH, width: int = WIDTH) -> DataFrame:
    """labels of nearest-source pixels at 1 / factor of the size."""
    if factor <= 1:
        return frames
    h, w = height // factor, width // factor
    source = [(y * height // h) * width + x * width // w for y in range(h) for x in range(w)]
    return frames.withColumn("labels", F.array(*[F.element_at("labels", i + 1) for i in source]))
