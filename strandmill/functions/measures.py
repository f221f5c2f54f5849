"""Scalar measures as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel rate of the modelled transmission, in Mbit/s.
BITRATE_MBPS = 10.0


def transmission_seconds(size_bytes: Column, mbps: float = BITRATE_MBPS) -> Column:
    return size_bytes * 8.0 / (mbps * 1e6)


def retention_ratio(kept: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(kept / total)


def size_reduction_pct(original: Column, reduced: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise((1 - reduced / original) * 100.0)


def normal_fps(fps: Column) -> Column:
    """Rates that mean 23.976 become exactly that; missing or absurd ones become 24."""
    valid = fps.isNotNull() & ~F.isnan(fps) & (fps > 1)
    return F.when(~valid, F.lit(24.0)).when(fps.between(23.9, 24.1), F.lit(24000.0 / 1001.0)).otherwise(fps)


def frame_estimate(frame_count: Column, stride: int, max_frames: int | None) -> Column:
    """How many frames a scan will give: the limit if there is one, else ceil(count / stride); unknown counts give null."""
    if max_frames is not None:
        return F.lit(max_frames).cast("long")
    return F.when(frame_count > 0, F.ceil(frame_count / F.lit(max(1, stride)))).cast("long")


def psnr(mse: Column) -> Column:
    return F.when(mse < 1e-12, F.lit(99.0)).otherwise(10.0 * F.log10(F.lit(65025.0) / mse))


def global_ssim(mu_a: Column, mu_b: Column, var_a: Column, var_b: Column, cov: Column) -> Column:
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    top = (2 * mu_a * mu_b + c1) * (2 * cov + c2)
    low = (mu_a * mu_a + mu_b * mu_b + c1) * (var_a + var_b + c2)
    return F.when(low == 0, F.lit(1.0)).otherwise(top / low)


def megabytes(size: Column, places: int = 3) -> Column:
    return F.round(size / F.lit(1024.0 * 1024.0), places)


def iou(a: Column, b: Column) -> Column:
    """Of two boxes struct(x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when(w * h <= 0, F.lit(0.0)).otherwise(w * h / (area(a) + area(b) - w * h + 1e-8))
