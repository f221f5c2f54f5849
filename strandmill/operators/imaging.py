"""Picture operators on BINARY frames (height, width, n_channels, data), as pandas UDFs over NumPy.

Only what NumPy defines is here. Models and codecs are hooks (``strandmill.sources.hooks``).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


def picture(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def area_resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        cover = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.clip(cover, 0, None) * m / n

    out = np.einsum("yh,hwc,xw->yxc", weights(img.shape[0], height), img.astype(float), weights(img.shape[1], width))
    return np.clip(np.rint(np.round(out, 9)), 0, 255).astype(np.uint8)


def limited_size(height: int, width: int, max_height: int, round_width: bool = True) -> tuple[int, int]:
    """Size at most ``max_height`` high; the width is rounded for scoring and cut off for compression; 0 sets no limit."""
    if max_height <= 0 or height <= max_height:
        return height, width
    scaled = width * max_height / height
    return max_height, max(1, int(round(scaled) if round_width else scaled))


def gray(img: np.ndarray) -> np.ndarray:
    """BGR or gray to gray levels."""
    if img.shape[2] == 1:
        return img[:, :, 0]
    b, g, r = (img[:, :, k].astype(float) for k in range(3))
    return np.rint(np.round(0.114 * b + 0.587 * g + 0.299 * r, 9)).astype(np.uint8)


def thumbnail(img: np.ndarray, height: int = 108, width: int = 192) -> np.ndarray:
    return area_resize(gray(img)[:, :, None], height, width)[:, :, 0]


def bgr_to_rgb(img: np.ndarray) -> np.ndarray:
    return img[:, :, ::-1]


def _filter3(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    p = np.pad(img.astype(float), 1, mode="reflect") if min(img.shape) > 1 else np.pad(img.astype(float), 1, mode="edge")
    return sum(kernel[i, j] * p[i : i + img.shape[0], j : j + img.shape[1]] for i in range(3) for j in range(3))


def edges(img: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge mask (0 or 1): Sobel gradients, thinned along the gradient, weak ones kept where joined to strong ones."""
    gx, gy = _filter3(img, SOBEL), _filter3(img, SOBEL.T)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    turn = np.round(np.rad2deg(np.arctan2(gy, gx)) / 45).astype(int) % 4
    thin = np.zeros_like(size, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (turn == k) & (size > at(-dy, -dx)) & (size >= at(dy, dx))
    weak, strong = thin & (size > low), thin & (size > high)
    while True:
        grown = dilate(strong.astype(np.uint8), 1).astype(bool) & weak | strong
        if (grown == strong).all():
            return strong.astype(np.uint8)
        strong = grown


def dilate(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    """3 x 3 maximum, ``rounds`` times."""
    for _ in range(rounds):
        p = np.pad(mask, 1)
        mask = np.maximum.reduce([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)])
    return mask


def gaussian(img: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(img.astype(float), ((r, r), (r, r), (0, 0)), mode="edge")
    rows = sum(k[i] * p[i : i + img.shape[0]] for i in range(2 * r + 1))
    return sum(k[i] * rows[:, i : i + img.shape[1]] for i in range(2 * r + 1))


def light_sharpen(rgb: np.ndarray, soft: np.ndarray, strength: float = 0.35) -> np.ndarray:
    """Unsharp mask by ``strength``, half of it where the guide ``soft`` has edges."""
    s = min(1.0, max(0.0, strength))
    if s == 0:
        return rgb
    sharp = np.clip(np.rint(rgb * (1.0 + s) - gaussian(rgb) * s), 0, 255)
    near = 0.5 * np.clip(gray(soft[:, :, ::-1]).astype(float) / 255 * 3.0, 0, 1)[..., None]
    return np.clip(rgb * (1 - near) + sharp * near, 0, 255).astype(np.uint8)


def post_refine(rgb: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """Blend the edge guide in, then smooth with a 5 x 5 bilateral filter (both sigmas 25)."""
    near = 0.35 * np.clip(gray(soft[:, :, ::-1]).astype(float) / 255 * 2.5, 0, 1)[..., None]
    mix = np.floor(rgb * (1 - near) + soft * near)
    p, h, w = np.pad(mix, ((2, 2), (2, 2), (0, 0)), mode="edge"), *mix.shape[:2]
    total, weight = np.zeros_like(mix), np.zeros((h, w, 1))
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if dy * dy + dx * dx <= 4:
                q = p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
                k = np.exp(-(dy * dy + dx * dx) / 1250 - np.abs(q - mix).sum(2, keepdims=True) ** 2 / 1250)
                total, weight = total + k * q, weight + k
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def fill_background(soft: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Fast reconstruction without a model: black pixels take the mean of their filled neighbours, ring by ring."""
    img, known = soft.astype(float), gray(soft[:, :, ::-1]) > 0
    if not known.any():
        return soft
    for _ in range(max(rounds, *soft.shape[:2])):
        if known.all():
            break
        pv, pk = np.pad(img * known[..., None], ((1, 1), (1, 1), (0, 0))), np.pad(known, 1).astype(float)
        h, w = known.shape
        total = sum(pv[i : i + h, j : j + w] for i in range(3) for j in range(3))
        count = sum(pk[i : i + h, j : j + w] for i in range(3) for j in range(3))
        ring = ~known & (count > 0)
        img[ring] = total[ring] / count[ring][:, None]
        known |= ring
    return np.clip(np.rint(img), 0, 255).astype(np.uint8)


def telea(img: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Fast-marching inpainting (Telea, 2004): masked pixels in order of their distance to the rest, each the weighted mean of
    what is known within ``radius``, extrapolated by its gradient. Weights: along the front's normal, by distance and by level."""
    h, w = mask.shape
    out, known, away = img.astype(float), mask == 0, np.where(mask == 0, 0.0, 1e6)
    edge = dilate(known.astype(np.uint8), 1).astype(bool) & ~known
    if not known.any() or known.all():
        return img.copy()
    heap = [(0.0, int(y), int(x)) for y, x in np.argwhere(known & (dilate(edge.astype(np.uint8), 1) > 0))]
    heapq.heapify(heap)
    frozen = known & False

    def solve(a: float, b: float) -> float:
        low, high = min(a, b), max(a, b)
        return low + 1.0 if high - low >= 1 else (low + high + np.sqrt(2.0 - (high - low) ** 2)) / 2

    def arrival(y: int, x: int) -> float:
        ups = [away[r, x] for r in (y - 1, y + 1) if 0 <= r < h and known[r, x]] or [1e6]
        sides = [away[y, c] for c in (x - 1, x + 1) if 0 <= c < w and known[y, c]] or [1e6]
        return solve(min(ups), min(sides))

    def slope(field: np.ndarray, y: int, x: int) -> tuple:
        """Central differences over known pixels, one-sided or none at the border of what is known."""
        found = []
        for dy, dx in ((1, 0), (0, 1)):
            fore = 0 <= y + dy < h and 0 <= x + dx < w and known[y + dy, x + dx]
            back = 0 <= y - dy < h and 0 <= x - dx < w and known[y - dy, x - dx]
            f = field[y + dy, x + dx] if fore else field[y, x]
            b = field[y - dy, x - dx] if back else field[y, x]
            found.append((f - b) / (2.0 if fore and back else 1.0))
        return found[0], found[1]

    while heap:
        _, y, x = heapq.heappop(heap)
        if frozen[y, x]:
            continue
        frozen[y, x] = True
        for r, c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if not (0 <= r < h and 0 <= c < w) or known[r, c]:
                continue
            away[r, c] = arrival(r, c)
            ty, tx = slope(away, r, c)
            total, weight = np.zeros(img.shape[2]), 0.0
            for qy in range(max(0, r - radius), min(h, r + radius + 1)):
                for qx in range(max(0, c - radius), min(w, c + radius + 1)):
                    dy, dx = r - qy, c - qx
                    if not known[qy, qx] or dy * dy + dx * dx > radius * radius:
                        continue
                    far = np.hypot(dy, dx)
                    along = max(abs(ty * dy + tx * dx) / far, 1e-6)
                    part = along / far**2 / (1 + abs(away[qy, qx] - away[r, c]))
                    gy, gx = slope(out, qy, qx)
                    total, weight = total + part * (out[qy, qx] + gy * dy + gx * dx), weight + part
            out[r, c] = np.clip(total / weight, 0, 255)
            known[r, c] = True
            heapq.heappush(heap, (float(away[r, c]), r, c))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def baseline_reconstruct(soft: np.ndarray) -> np.ndarray:
    """Reconstruction without a model: what lies within four pixels of an edge is filled in from outside."""
    mask = (gray(soft[:, :, ::-1]) > 0).astype(np.uint8)
    return telea(soft, dilate(mask, 4)) if mask.any() else soft


def warp(img: np.ndarray, flow: np.ndarray, t: float) -> np.ndarray:
    """Bilinear samples of ``img`` at places moved by ``t`` times the flow; beyond the border its last pixels."""
    h, w = img.shape[:2]
    y, x = np.mgrid[:h, :w]
    x, y = np.clip(x + flow[..., 0] * t, 0, w - 1), np.clip(y + flow[..., 1] * t, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), (x - x0)[..., None], (y - y0)[..., None]
    a = img.astype(float)
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def flow_interpolate(a0: np.ndarray, a1: np.ndarray, flow: np.ndarray, alpha: float, mix: float = 0.15, both_ways: bool = True) -> np.ndarray:
    """A frame between two keys by motion compensation, mixed with the linear blend. ``flow`` comes from a hook."""
    cut = lambda v: np.floor(np.clip(v, 0, 255))
    line = cut(a0 * (1.0 - alpha) + a1 * alpha)
    if mix >= 1:
        return line.astype(np.uint8)
    moved = np.rint(warp(a0, flow, alpha))
    if both_ways:
        moved = cut(moved * (1.0 - alpha) + np.rint(warp(a1, flow, alpha - 1.0)) * alpha)
    return cut(moved * (1 - mix) + line * mix).astype(np.uint8) if mix > 0 else moved.astype(np.uint8)


def resized(frames: DataFrame, max_height: int, round_width: bool = True) -> DataFrame:
    """Frames at most ``max_height`` high; ``scaled`` tells which were made smaller."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                h, w = limited_size(r.height, r.width, max_height, round_width)
                data = r.data if (h, w) == (r.height, r.width) else area_resize(picture(r.data, r.height, r.width, r.n_channels), h, w).tobytes()
                rows.append((r.video_id, r.frame_idx, h, w, r.n_channels, data, h != r.height))
            yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "height", "width", "n_channels", "data", "scaled"])

    return frames.select("video_id", "frame_idx", "height", "width", "n_channels", "data").mapInPandas(run, "video_id string, frame_idx int, height int, width int, n_channels int, data binary, scaled boolean")


def edge_density(low: float = 50, high: float = 150) -> Column:
    """Pandas UDF (height, width, n_channels, data) -> share of edge pixels."""

    @F.pandas_udf("double")
    def density(height: pd.Series, width: pd.Series, n_channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([float(edges(gray(picture(d, h, w, c)), low, high).mean()) for h, w, c, d in zip(height, width, n_channels, data)])

    return density("height", "width", "n_channels", "data")


def soft_edges(frames: DataFrame, palette: list[tuple[float, float, float]], low: float = 60, high: float = 150, grow: int = 0) -> DataFrame:
    """(video_id, frame_idx, height, width, labels): nearest palette entry of each edge pixel of BGR frames, plus 1; 0 elsewhere."""
    colours = np.array(palette, float)

    @F.pandas_udf("array<int>")
    def label(height: pd.Series, width: pd.Series, n_channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, d in zip(height, width, n_channels, data):
            img = picture(d, h, w, c)
            mask = dilate(edges(gray(img), low, high), grow).astype(bool)
            rgb = bgr_to_rgb(img) if c == 3 else np.repeat(img, 3, axis=2)
            near = ((rgb[mask].astype(float)[:, None] - colours[None]) ** 2).sum(2).argmin(1) + 1 if mask.any() else []
            flat = np.zeros((h, w), np.int32)
            flat[mask] = near
            out.append(flat.ravel())
        return pd.Series(out)

    return frames.select("video_id", "frame_idx", "height", "width", label("height", "width", "n_channels", "data").alias("labels"))


PICTURE = ("height", "width", "n_channels", "data")


def from_pixels(frames: DataFrame, height: int, width: int, channels: int = 1) -> DataFrame:
    """(video_id, frame_idx, height, width, n_channels, data) of (video_id, frame_idx, px)."""
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return frames.select("video_id", "frame_idx", F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("n_channels"), data.alias("data"))


def to_pixels(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, px) of frames (.., data)."""
    px = F.pandas_udf(lambda data: pd.Series([np.frombuffer(d, np.uint8).astype(np.int32) for d in data]), "array<int>")
    return frames.select("video_id", "frame_idx", px("data").alias("px"))


def gray_thumbnails(frames: DataFrame, height: int = 108, width: int = 192) -> DataFrame:
    """(video_id, frame_idx, px): small gray pictures of BGR or gray frames, as motion is measured on them."""

    @F.pandas_udf("array<int>")
    def small(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([thumbnail(picture(*x), height, width).ravel().astype(np.int32) for x in zip(d, h, w, c)])

    return frames.select("video_id", "frame_idx", small(*PICTURE).alias("px"))


def rgb_frames(frames: DataFrame) -> DataFrame:
    """BGR frames as RGB frames."""
    turn = F.pandas_udf(lambda h, w, c, d: pd.Series([bgr_to_rgb(picture(x, *size)).tobytes() for x, *size in zip(d, h, w, c)]), "binary")
    return frames.withColumn("data", turn(*PICTURE))


def dilated(frames: DataFrame, height: int, width: int, rounds: int = 1) -> DataFrame:
    """(video_id, frame_idx, labels): label maps in which each pixel takes the largest label around it, ``rounds`` times."""
    grow = F.pandas_udf(lambda maps: pd.Series([dilate(np.asarray(m, np.int32).reshape(height, width), rounds).ravel() for m in maps]), "array<int>")
    return frames.select("video_id", "frame_idx", grow("labels").alias("labels"))


def refined(frames: DataFrame, soft: DataFrame, post: bool = True, sharpen: float = 0.0) -> DataFrame:
    """RGB frames refined by their edge guides ``soft`` (RGB frames of the same size): blended and smoothed, then sharpened."""

    @F.pandas_udf("binary")
    def refine(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for data, guide, *size in zip(d, g, h, w, c):
            img, edge = picture(data, *size), picture(guide, *size)
            img = post_refine(img, edge) if post else img
            out.append(light_sharpen(img, edge, sharpen).tobytes() if sharpen > 0 else img.tobytes())
        return pd.Series(out)

    both = frames.join(soft.select("video_id", "frame_idx", F.col("data").alias("guide")), ["video_id", "frame_idx"])
    return both.select("video_id", "frame_idx", "height", "width", "n_channels", refine(*PICTURE, "guide").alias("data"))


def filled(soft: DataFrame) -> DataFrame:
    """Soft-edge RGB frames with their background filled in, without a model."""
    fill = F.pandas_udf(lambda h, w, c, d: pd.Series([fill_background(picture(x, *size)).tobytes() for x, *size in zip(d, h, w, c)]), "binary")
    return soft.withColumn("data", fill(*PICTURE))


def baseline_filled(soft: DataFrame) -> DataFrame:
    """Soft-edge RGB frames reconstructed without a model."""
    fill = F.pandas_udf(lambda h, w, c, d: pd.Series([baseline_reconstruct(picture(x, *size)).tobytes() for x, *size in zip(d, h, w, c)]), "binary")
    return soft.withColumn("data", fill(*PICTURE))


def ssim_of(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean structural similarity over all ``size`` x ``size`` windows that lie in the picture, with sample covariances; channels are averaged."""
    if a.ndim == 3:
        return float(np.mean([ssim_of(a[..., k], b[..., k], size) for k in range(a.shape[2])]))
    if min(a.shape) < size:
        raise ValueError(f"pictures of {a.shape} have no window of {size} x {size}")
    a, b = a.astype(float), b.astype(float)

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2

    ma, mb = mean(a), mean(b)
    scale = size**2 / (size**2 - 1)
    va, vb, cov = (scale * (mean(x * y) - mx * my) for x, y, mx, my in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def windowed_ssim(a: DataFrame, b: DataFrame, size: int = 7) -> DataFrame:
    """(video_id, frame_idx, ssim) of picture frames matched by place."""
    near = F.pandas_udf(lambda h, w, c, x, y: pd.Series([ssim_of(picture(p, *s), picture(q, *s), size) for p, q, *s in zip(x, y, h, w, c)]), "double")
    both = a.join(b.select("video_id", "frame_idx", F.col("data").alias("other")), ["video_id", "frame_idx"])
    return both.select("video_id", "frame_idx", near(*PICTURE, "other").alias("ssim"))


def block_flow(a0: np.ndarray, a1: np.ndarray, block: int = 4, reach: int = 2) -> np.ndarray:
    """Flow (dx, dy) from ``a0`` to ``a1`` by exhaustive block matching; the shortest move of those tied."""
    g0, g1 = gray(a0).astype(float), gray(a1).astype(float)
    h, w = g0.shape
    p = np.pad(g1, reach, mode="edge")
    best, flow = np.full((h, w), np.inf), np.zeros((h, w, 2))
    edges_y, edges_x = np.arange(0, h, block), np.arange(0, w, block)
    for dy, dx in sorted(((y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)), key=lambda m: (m[0] ** 2 + m[1] ** 2, m)):
        off = np.abs(g0 - p[reach + dy : reach + dy + h, reach + dx : reach + dx + w])
        cost = np.add.reduceat(np.add.reduceat(off, edges_y, axis=0), edges_x, axis=1)
        cost = np.repeat(np.repeat(cost, block, axis=0)[:h], block, axis=1)[:, :w]
        better = cost < best - 1e-9
        best[better], flow[better] = cost[better], (dx, dy)
    return flow


def flow_interpolation(frames: DataFrame, interval: int, flow: str = "block", mix: float = 0.15) -> DataFrame:
    """(video_id, frame_idx, height, width, n_channels, data): frames between keys by motion compensation; only key frames' data is read."""
    from strandmill.operators.reconstruct import key_segments
    from strandmill.sources import hooks

    make = hooks.lookup("optical_flow", flow)
    keys = frames.where(F.col("frame_idx") % interval == 0).select("video_id", "frame_idx", *PICTURE)
    first = keys.select("video_id", F.col("frame_idx").alias("key0"), *PICTURE)
    second = keys.select("video_id", F.col("frame_idx").alias("key1"), F.col("data").alias("next"))
    both = key_segments(frames.select("video_id", "frame_idx"), interval).join(first, ["video_id", "key0"]).join(second, ["video_id", "key1"])

    @F.pandas_udf("binary")
    def between(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
        find, out, held = make(), [], (None, None)
        for d0, d1, t, *size in zip(d, n, alpha, h, w, c):
            if t == 0:
                out.append(d0)
                continue
            a0, a1 = picture(d0, *size), picture(d1, *size)
            if held[0] != (d0, d1):
                held = ((d0, d1), find(a0, a1))
            out.append(flow_interpolate(a0, a1, held[1], t, mix).tobytes())
        return pd.Series(out)

    return both.select("video_id", "frame_idx", "height", "width", "n_channels", between(*PICTURE, "next", "alpha").alias("data"))
