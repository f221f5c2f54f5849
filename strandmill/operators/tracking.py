"""Greedy object tracking, and traffic measures from tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.vocabulary import TRAFFIC_CLASSES
from strandmill.operators.sequential import fold

LEAST_IOU, MAX_AGE, LEAST_CONF = 0.25, 30, 0.25
TRACKED = "video_id string, frame_idx long, det long, track_id int, cx double, cy double, speed double"


class Tracker:
    """Tracks of one video. A box goes to the track whose centre, given the box's own size, overlaps it most.

    Two boxes of a frame may go to one track. Tracks out of age can't match again and are let go, so the state is bounded
    by what was seen within MAX_AGE frames.
    """

    def __init__(self, video_id: str, fps: float):
        self.video_id, self.fps, self.count = video_id, fps, 0
        self.ids, self.cx, self.cy, self.seen = (np.empty(0) for _ in range(4))

    def put(self, x1: float, y1: float, x2: float, y2: float, frame: int) -> tuple[int, float, float, float | None]:
        cx, cy, w, h = 0.5 * (x1 + x2), 0.5 * (y1 + y2), x2 - x1, y2 - y1
        if len(self.ids):
            over = np.maximum(0, w - np.abs(self.cx - cx)) * np.maximum(0, h - np.abs(self.cy - cy))
            iou = np.where(over > 0, over / (2 * w * h - over + 1e-8), 0.0)
            iou = np.where((frame - self.seen <= MAX_AGE) & (iou >= LEAST_IOU), iou, 0.0)
            k = int(iou.argmax())
            if iou[k] > 0:
                speed = None
                if self.seen[k] < frame and self.fps > 0:
                    speed = float(np.hypot(cx - self.cx[k], cy - self.cy[k]) / ((frame - self.seen[k]) / self.fps))
                self.cx[k], self.cy[k], self.seen[k] = cx, cy, frame
                return int(self.ids[k]), cx, cy, speed
        self.count += 1
        live = frame - self.seen <= MAX_AGE
        self.ids, self.cx, self.cy, self.seen = (np.append(a[live], v) for a, v in ((self.ids, self.count), (self.cx, cx), (self.cy, cy), (self.seen, frame)))
        return self.count, cx, cy, None

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(self.video_id, f, d, *self.put(a, b, c, e, f)) for f, d, a, b, c, e in zip(rows["frame_idx"].tolist(), rows["det"].tolist(), *(rows[k].tolist() for k in ("x1", "y1", "x2", "y2")))]
        return pd.DataFrame(out, columns=["video_id", "frame_idx", "det", "track_id", "cx", "cy", "speed"]).astype({"speed": "float64"})

    def finish(self):
        return None


def traffic_boxes(detections: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Boxes that count: sure enough, of a traffic class, and in ``allowed`` (video_id, frame_idx) if given."""
    rows = detections.where((F.col("conf") >= LEAST_CONF) & F.col("class_id").isin(*TRAFFIC_CLASSES))
    return rows if allowed is None else rows.join(allowed.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")


def track(boxes: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video_id, frame_idx, det, track_id, cx, cy, speed) of (video_id, frame_idx, det, box); det orders boxes of a frame."""
    rows = boxes.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("det").cast("long").alias("det"), "box.x1", "box.y1", "box.x2", "box.y2")
    return fold(rows, TRACKED, lambda video: Tracker(video, fps), order=("frame_idx", "det"))


def traffic_stats(tracks: DataFrame) -> DataFrame:
    """(video_id, track_count, avg_speed, max_speed)."""
    zero: Column = F.lit(0.0)
    return tracks.groupBy("video_id").agg(F.countDistinct("track_id").alias("track_count"), F.coalesce(F.avg("speed"), zero).alias("avg_speed"), F.coalesce(F.max("speed"), zero).alias("max_speed"))


def compare_traffic(reference: DataFrame, test: DataFrame) -> DataFrame:
    """(video_id, id_retention_pct, avg_speed_error_pct, max_speed_error_pct)."""
    r = reference.select("video_id", *[F.col(c).alias(f"r_{c}") for c in ("track_count", "avg_speed", "max_speed")])
    both = r.join(test, "video_id", "left").na.fill(0)
    error = lambda c: F.abs(F.col(c) - F.col(f"r_{c}")) / (F.col(f"r_{c}") + 1e-8) * 100
    kept = F.when(F.col("r_track_count") == 0, F.lit(100.0)).otherwise(F.col("track_count") / F.col("r_track_count") * 100)
    return both.select("video_id", kept.alias("id_retention_pct"), error("avg_speed").alias("avg_speed_error_pct"), error("max_speed").alias("max_speed_error_pct"))
