"""Sampling, then coding what is kept: one run from frames to a bitstream and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import measures
from strandmill.operators import selection
from strandmill.plans import compressor
from strandmill.session import durable


@dataclass
class Combo:
    labels: DataFrame
    packets: DataFrame
    decoded: DataFrame
    report: DataFrame


def renumbered(frames: DataFrame) -> DataFrame:
    """Kept frames numbered from 0 on in each video, with src_idx, their number before.

    The numbers come from counts of stretches of 4096 frames and places within them, so a long video is many tasks.
    """
    parts = frames.withColumn("__part", F.floor(F.col("frame_idx") / 4096).cast("long"))
    sizes = parts.groupBy("video_id", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("video_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("video_id", "__part").orderBy("frame_idx")) - 1
    both = parts.withColumn("__nth", nth).join(sizes.select("video_id", "__part", before.alias("__before")), ["video_id", "__part"])
    return both.withColumnRenamed("frame_idx", "src_idx").withColumn("frame_idx", (F.col("__before") + F.col("__nth")).cast("int")).drop("__part", "__nth", "__before")


def run_combo(labels: DataFrame, kept: DataFrame, cfg: dict, source_bytes: int) -> Combo:
    """Code the label maps (video_id, frame_idx, labels) of the kept frames (video_id, frame_idx) and decode them again.

    report: (video_id, n_total, n_kept, coded_bytes, saving_pct, tx_source_s, tx_coded_s); ``source_bytes`` is a frame's size.
    """
    own = durable(renumbered(selection.kept_frames(labels, kept)))
    packets = durable(compressor.compress(own.select("video_id", "frame_idx", "labels"), cfg))
    decoded = compressor.decompress(packets, cfg["soft_edge"]["keyframe_interval"]).join(own.select("video_id", "frame_idx", "src_idx"), ["video_id", "frame_idx"])
    totals = labels.groupBy("video_id").agg(F.count("*").alias("n_total"))
    sizes = packets.groupBy("video_id").agg(F.count("*").alias("n_kept"), F.sum(F.octet_length("payload")).cast("long").alias("coded_bytes"))
    source = F.col("n_total") * source_bytes
    both = totals.join(sizes, "video_id", "left").na.fill(0, ["n_kept", "coded_bytes"])
    report = both.select(
        "video_id", "n_total", "n_kept", "coded_bytes", F.round(measures.size_reduction_pct(source, F.col("coded_bytes")), 6).alias("saving_pct"),
        F.round(measures.transmission_seconds(source), 9).alias("tx_source_s"), F.round(measures.transmission_seconds(F.col("coded_bytes")), 9).alias("tx_coded_s"),
    )
    return Combo(own, packets, decoded, report)
