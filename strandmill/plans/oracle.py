"""DuckDB SQL for the query catalogue, written from the definitions and not from the Spark plans."""

from __future__ import annotations

FEATURES = """f AS (
  SELECT 'v' || (vec_id // 100) AS video_id, CAST(vec_id % 100 AS INT) AS frame_idx, embedding::DOUBLE[] AS feat FROM embeddings)"""

PIXELS = f"""{FEATURES}, fr AS (
  SELECT video_id, frame_idx, list_transform(feat, lambda x: CAST(floor((greatest(least(4 * x, 1.0), -1.0) + 1) * 127.5) AS INT)) AS px FROM f)"""

LABELS = f"""{PIXELS}, lf AS (
  SELECT video_id, frame_idx, list_transform(px, lambda v: greatest(0, CAST(floor((v - 96) / 20.0) AS INT))) AS labels FROM fr)"""

GRID = """ev AS (
  SELECT 'v' || (user_id % 10) AS video_id, CAST(floor(epoch(ts) / 3600) AS INT) - 473352 AS frame_idx, value,
         CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 1 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 3 WHEN 'view' THEN 9 END AS class_id
  FROM events),
gr AS (
  SELECT v.video_id, i.frame_idx, coalesce(e.class_ids, []) AS class_ids, coalesce(e.level, 0.0) AS level
  FROM (SELECT DISTINCT video_id FROM ev) v CROSS JOIN (SELECT CAST(range AS INT) AS frame_idx FROM range(720)) i
  LEFT JOIN (SELECT video_id, frame_idx, list(class_id ORDER BY class_id) AS class_ids, round(avg(value), 6) AS level FROM ev GROUP BY ALL) e
    ON e.video_id = v.video_id AND e.frame_idx = i.frame_idx)"""


def _carried(interval: int, name: str = "ca") -> str:
    return f"""{name} AS (
  SELECT video_id, frame_idx, level,
         last_value(CASE WHEN frame_idx % {interval} = 0 THEN class_ids END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx) AS class_ids
  FROM gr)"""


MOTION = """mo AS (
  SELECT video_id, frame_idx, CASE WHEN step IS NULL THEN 1.0 WHEN max(step) OVER (PARTITION BY video_id) > 0 THEN step / max(step) OVER (PARTITION BY video_id) ELSE 0.0 END AS motion
  FROM (SELECT video_id, frame_idx, abs(level - lag(level) OVER (PARTITION BY video_id ORDER BY frame_idx)) AS step FROM gr))"""

#: Class names 1 and 3 are rare. Observation ordinals up to 59 back count.
WEIGHTS = """ob AS (
  SELECT video_id, frame_idx // 10 AS obs, unnest(class_ids) AS class_id FROM ca WHERE frame_idx % 10 = 0),
cw AS (
  SELECT c.video_id, c.frame_idx, c.class_id, count(o.obs) AS fc
  FROM (SELECT DISTINCT video_id, frame_idx, frame_idx // 10 AS obs, class_id FROM (SELECT video_id, frame_idx, unnest(class_ids) AS class_id FROM ca)) c
  LEFT JOIN ob o ON o.video_id = c.video_id AND o.class_id = c.class_id AND o.obs BETWEEN c.obs - 59 AND c.obs
  GROUP BY ALL),
we AS (
  SELECT ca.video_id, ca.frame_idx, coalesce(max(1.0 / ln(fc + 2) * CASE WHEN class_id IN (1, 3) THEN 1.25 ELSE 1.0 END), 1.0) AS class_weight
  FROM ca LEFT JOIN cw USING (video_id, frame_idx) GROUP BY ALL)"""

GRID_FEATURES = """gf AS (
  SELECT 'v' || v AS video_id, frame_idx, embedding::DOUBLE[] AS feat
  FROM (SELECT DISTINCT user_id % 10 AS v FROM events) CROSS JOIN (SELECT CAST(range AS INT) AS frame_idx FROM range(720)) i
  JOIN embeddings ON vec_id = (v * 720 + frame_idx) % (SELECT count(*) FROM embeddings))"""


def _uniform(source: str, name: str, history: int, size: int) -> str:
    """delta and novelty against ``size`` evenly spaced frames of the last ``history``."""
    return f"""{name}_h AS (
  SELECT video_id, frame_idx, feat, coalesce(list(feat) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING), []) AS past FROM {source}),
{name}_c AS (
  SELECT *, CASE WHEN len(past) <= {size} THEN past ELSE list_transform(range({size}), lambda i: past[1 + least(len(past) - 1, i * greatest(1, (len(past) - 1) // {max(size - 1, 1)}))]) END AS ctx FROM {name}_h),
{name} AS (
  SELECT video_id, frame_idx, CAST(len(ctx) AS INT) AS n_context,
         CASE WHEN len(ctx) = 0 THEN 1.0 ELSE 1 - list_max(list_transform(ctx, lambda e: list_dot_product(feat, e))) END AS delta_map,
         CASE WHEN len(ctx) = 0 THEN 1.0 ELSE least(1.0, list_min(list_transform(ctx, lambda e: list_distance(feat, e))) / 1.414) END AS novelty
  FROM {name}_c)"""


BLEND = """pa AS (
  SELECT cx.video_id, cx.frame_idx, delta_map, novelty, n_context, motion, class_weight, CAST(len(class_ids) AS INT) AS n_objects, delta_map * novelty * class_weight AS semantic
  FROM cx JOIN mo USING (video_id, frame_idx) JOIN we USING (video_id, frame_idx) JOIN ca USING (video_id, frame_idx)),
b1 AS (SELECT *, semantic + 0.35 * motion AS s0 FROM pa),
b2 AS (SELECT *, CASE WHEN n_objects > 0 THEN greatest(s0, 0.2) * (1 + 0.12 * least(n_objects, 8)) ELSE s0 END AS s1 FROM b1),
sc AS (
  SELECT * EXCLUDE (s0, s1), round(greatest(CASE
    WHEN n_objects >= 2 AND motion >= 0.025 THEN greatest(s1, 0.35) * (1 + 0.15 * least(n_objects, 10))
    WHEN n_objects >= 1 AND motion >= 0.0125 THEN s1 * (1 + 0.08 * least(n_objects, 6)) ELSE s1 END, 0.0), 9) AS score
  FROM b2)"""

SCORED = ",\n".join([GRID, _carried(12), MOTION, WEIGHTS, GRID_FEATURES, _uniform("gf", "cx", 15, 3), BLEND])

PRICES = """ps AS (
  SELECT 'v' || (l_suppkey % 8) AS video_id, l_orderkey * 8 + l_linenumber AS frame_idx, l_extendedprice / 100000.0 AS score FROM lineitem)"""

PIXEL_MOTION = """pm AS (
  SELECT video_id, frame_idx, coalesce(list_sum(list_transform(list_zip(px, before), lambda p: abs(p[1] - p[2]))) / 64.0 / 255, 1.0) AS motion
  FROM (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY frame_idx) AS before FROM fr))"""

ENTROPY = """en AS (
  SELECT video_id, frame_idx, -sum(c / 64.0 * log2(c / 64.0 + 1e-12)) AS entropy
  FROM (SELECT video_id, frame_idx, v // 4 AS bin, count(*) AS c FROM (SELECT video_id, frame_idx, unnest(px) AS v FROM fr) GROUP BY ALL) GROUP BY ALL)"""

NON_UNIFORM = f"""{PIXELS}, {PIXEL_MOTION}, {ENTROPY},
ch AS (SELECT video_id, frame_idx, CASE WHEN frame_idx = 0 THEN 0.0 ELSE motion * 255 END AS motion FROM pm),
nu AS (
  SELECT video_id, frame_idx, round(0.6 * motion / (max(motion) OVER w + 1e-8) + 0.4 * entropy / (max(entropy) OVER w + 1e-8), 9) AS score
  FROM ch JOIN en USING (video_id, frame_idx) WINDOW w AS (PARTITION BY video_id)),
nk AS (
  SELECT video_id, frame_idx, score FROM nu
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) <= greatest(1, round_even(count(*) OVER (PARTITION BY video_id) * 0.2, 0)))"""


def _tau(scores: str, name: str, mad: float, low: float, flat: float) -> str:
    return f"""{name}_1 AS (
  SELECT video_id, quantile_cont(score, 0.95) + 1e-12 AS scale, median(score) AS mid, quantile_cont(score, {flat}) AS flat, quantile_cont(score, {low}) AS low FROM {scores} GROUP BY ALL),
{name}_2 AS (SELECT video_id, median(abs(score / scale - mid / scale)) + 1e-12 AS mad FROM {scores} JOIN {name}_1 USING (video_id) GROUP BY ALL),
{name} AS (
  SELECT video_id, CASE WHEN scale < 1e-4 THEN flat ELSE greatest(CASE WHEN mad < 0.02 THEN flat / scale ELSE mid / scale + {mad} * mad END, low / scale * 0.5) * scale END AS tau
  FROM {name}_1 JOIN {name}_2 USING (video_id))"""


def _rich(objects: int) -> str:
    return f"""ri AS (
  SELECT video_id, count(*) AS n,
         avg(CASE WHEN o >= {objects} AND motion >= 0.025 THEN 1.0 ELSE 0.0 END) AS busy,
         least(1.0, greatest(0.0, avg(CASE WHEN o >= {objects} AND motion >= 0.025 THEN 1.0 ELSE 0.0 END), 0.9 * avg(CASE WHEN o >= 1 THEN 1.0 ELSE 0.0 END),
           0.85 * avg(CASE WHEN o >= 2 THEN 1.0 ELSE 0.0 END), 0.8 * avg(least(o, 6)) / 6.0, 0.6 * avg(CASE WHEN motion >= 0.0125 THEN 1.0 ELSE 0.0 END))) AS information
  FROM (SELECT video_id, frame_idx, len(class_ids) AS o, motion FROM ca JOIN mo USING (video_id, frame_idx)) GROUP BY ALL)"""


def _bounds(part: str, low: float, low_busy: float, soft: float, soft_busy: float, high: float) -> str:
    return f"""bo AS (
  SELECT video_id, n, n_min, soft_n, greatest(soft_n, CAST(round_even(n * {high}, 0) AS BIGINT)) AS n_max
  FROM (SELECT *, greatest(n_min, CAST(round_even(n * soft_r, 0) AS BIGINT)) AS soft_n
        FROM (SELECT *, greatest(1, CAST(round_even(n * min_r, 0) AS BIGINT)) AS n_min
              FROM (SELECT video_id, n, {low} + {part} * ({low_busy} - {low}) AS min_r,
                           least(greatest({soft} + {part} * ({soft_busy} - {soft}), {low} + {part} * ({low_busy} - {low})), {high} - 0.02) AS soft_r FROM ri))))"""


PALETTE = [(0, 0, 0), (64, 32, 16), (96, 160, 64), (160, 96, 192), (224, 200, 160), (255, 255, 255)]
_PALETTE_ROWS = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(PALETTE))

#: Changed pixels of each frame against the one before in its segment of 30.
TRIPLES = f"""{LABELS}, tr AS (
  SELECT video_id, frame_idx, i // 8 AS y, i % 8 AS x, labels[i + 1] AS label
  FROM (SELECT video_id, frame_idx, labels, lag(labels) OVER (PARTITION BY video_id, frame_idx // 30 ORDER BY frame_idx) AS prev, CAST(unnest(range(64)) AS INT) AS i FROM lf)
  WHERE labels[i + 1] <> coalesce(prev[i + 1], 0))"""

BETWEEN_KEYS = f"""{PIXELS}, ks AS (
  SELECT video_id, frame_idx, frame_idx // 10 * 10 AS k0, CASE WHEN frame_idx // 10 * 10 + 10 >= max(frame_idx) OVER (PARTITION BY video_id) + 1 THEN frame_idx // 10 * 10 ELSE frame_idx // 10 * 10 + 10 END AS k1 FROM fr),
ki AS (
  SELECT ks.video_id, ks.frame_idx,
         list_transform(list_zip(a.px, b.px), lambda p: CAST(greatest(0, least(255, floor(round(p[1] * (1 - CASE WHEN k1 = k0 THEN 0 ELSE (ks.frame_idx - k0) / 10.0 END) + p[2] * CASE WHEN k1 = k0 THEN 0 ELSE (ks.frame_idx - k0) / 10.0 END, 6)))) AS INT)) AS px
  FROM ks JOIN fr a ON a.video_id = ks.video_id AND a.frame_idx = k0 JOIN fr b ON b.video_id = ks.video_id AND b.frame_idx = k1)"""

QUALITY = f"""{BETWEEN_KEYS}, pr AS (
  SELECT video_id, frame_idx, CAST(p[1] AS DOUBLE) AS a, CAST(p[2] AS DOUBLE) AS b
  FROM (SELECT fr.video_id, fr.frame_idx, unnest(list_zip(fr.px, ki.px)) AS p FROM fr JOIN ki USING (video_id, frame_idx))),
qu AS (
  SELECT video_id, frame_idx, CASE WHEN avg((a - b) * (a - b)) < 1e-12 THEN 99.0 ELSE 10 * log10(65025 / avg((a - b) * (a - b))) END AS psnr,
         (2 * avg(a) * avg(b) + 6.5025) * (2 * covar_pop(a, b) + 58.5225) / ((avg(a) * avg(a) + avg(b) * avg(b) + 6.5025) * (var_pop(a) + var_pop(b) + 58.5225)) AS ssim
  FROM pr GROUP BY ALL)"""

def _canny(name: str, source: str, low: int, high: int) -> str:
    """Edge pixels ``name`` (video_id, frame_idx, p) of ``source`` (video_id, frame_idx, g), g a list of 8 x 8 gray levels."""

    def at(dy: int, dx: int) -> str:
        y, x = (f"(CASE WHEN {v} + {d} < 0 THEN 1 WHEN {v} + {d} > 7 THEN 6 ELSE {v} + {d} END)" for v, d in (("y", dy), ("x", dx)))
        return f"g[{y} * 8 + {x} + 1]"

    def size(dy: int, dx: int) -> str:
        return f"(CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN sizes[(y + {dy}) * 8 + x + {dx} + 1] ELSE 0 END)"

    gx = " + ".join(f"{w} * ({at(dy, 1)} - {at(dy, -1)})" for dy, w in ((-1, 1), (0, 2), (1, 1)))
    gy = " + ".join(f"{w} * ({at(1, dx)} - {at(-1, dx)})" for dx, w in ((-1, 1), (0, 2), (1, 1)))
    thin = " OR ".join(f"(turn = {k} AND size > {size(-dy, -dx)} AND size >= {size(dy, dx)})" for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))))
    return f"""{name}_p AS (SELECT video_id, frame_idx, p, p // 8 AS y, p % 8 AS x, g FROM (SELECT *, unnest(range(64)) AS p FROM {source})),
{name}_g AS (SELECT video_id, frame_idx, p, y, x, {gx} AS gx, {gy} AS gy FROM {name}_p),
{name}_l AS (SELECT video_id, frame_idx, list(abs(gx) + abs(gy) ORDER BY p) AS sizes FROM {name}_g GROUP BY ALL),
{name}_t AS (SELECT video_id, frame_idx, p, y, x, abs(gx) + abs(gy) AS size, sizes, CAST((round(degrees(atan2(gy, gx)) / 45) + 8) AS INT) % 4 AS turn FROM {name}_g JOIN {name}_l USING (video_id, frame_idx)),
{name}_w AS (SELECT video_id, frame_idx, p, y, x, size FROM {name}_t WHERE size > {low} AND ({thin})),
{name} AS (
  SELECT video_id, frame_idx, p, y, x FROM {name}_w WHERE size > {high}
  UNION
  SELECT w.video_id, w.frame_idx, w.p, w.y, w.x FROM {name} e JOIN {name}_w w ON w.video_id = e.video_id AND w.frame_idx = e.frame_idx AND abs(w.y - e.y) <= 1 AND abs(w.x - e.x) <= 1)"""


#: Kept frames renumbered, and their changed pixels.
COMBO = f"""{NON_UNIFORM}, lf AS (SELECT video_id, frame_idx, list_transform(px, lambda v: greatest(0, CAST(floor((v - 96) / 20.0) AS INT))) AS labels FROM fr),
ko AS (SELECT video_id, lf.frame_idx AS src_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY lf.frame_idx) - 1 AS INT) AS frame_idx, labels FROM lf JOIN nk USING (video_id, frame_idx)),
kt AS (
  SELECT video_id, frame_idx, i FROM (SELECT video_id, frame_idx, labels, lag(labels) OVER (PARTITION BY video_id, frame_idx // 30 ORDER BY frame_idx) AS prev, CAST(unnest(range(64)) AS INT) AS i FROM ko)
  WHERE labels[i + 1] <> coalesce(prev[i + 1], 0))"""

#: Gray pixels read three times, as adapters.colour_frames does.
COLOURS = f"""{PIXELS}, cl AS (SELECT video_id, frame_idx, CAST(p AS INT) AS p, px[p + 1] AS b, px[(p + 21) % 64 + 1] AS g, px[(p + 42) % 64 + 1] AS r FROM (SELECT *, unnest(range(64)) AS p FROM fr))"""


def _shrunk(h: int, w: int, to_h: int, to_w: int) -> str:
    """Area means of pc (video_id, frame_idx, p, v), h x w pixels, as rs (video_id, frame_idx, y, x, v)."""

    def cover(n: int, m: int, o: str, i: str) -> str:
        return f"greatest(0, least(({o} + 1) * {n} / {m}.0, {i} + 1) - greatest({o} * {n} / {m}.0, {i})) * {m} / {n}.0"

    return f"""rs AS (
  SELECT video_id, frame_idx, y, x, CAST(round_even(round(sum({cover(h, to_h, 'y', f'(p // {w})')} * {cover(w, to_w, 'x', f'(p % {w})')} * v), 9), 0) AS INT) AS v
  FROM pc, (SELECT range AS y FROM range({to_h})), (SELECT range AS x FROM range({to_w})) GROUP BY ALL)"""


#: Scores of the motion-gated run: the frames that pass are scored in full against each other's history.
GATED = ",\n".join([
    GRID, _carried(8), MOTION, WEIGHTS, GRID_FEATURES,
    """gl AS (SELECT video_id, quantile_cont(motion, 0.65) AS lim FROM mo GROUP BY ALL),
gt AS (SELECT video_id, frame_idx, round(motion, 9) AS m, round(motion, 9) >= round(lim, 9) OR frame_idx % 6 = 0 AS candidate FROM mo JOIN gl USING (video_id)),
gc AS (SELECT gf.* FROM gf JOIN gt USING (video_id, frame_idx) WHERE candidate)""",
    _uniform("gc", "cx", 15, 3), BLEND,
    "gs AS (SELECT gt.video_id, gt.frame_idx, CASE WHEN candidate THEN coalesce(score, m) ELSE m END AS score FROM gt LEFT JOIN sc USING (video_id, frame_idx))",
])

TRACKED = """bx AS (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS video_id, CAST(dayofyear(l_shipdate) AS INT) AS frame_idx, CAST(l_linenumber % 10 AS INT) AS class_id, l_discount * 5 + 0.2 AS conf FROM lineitem)"""


def _tracks(name: str, where: str = "true") -> str:
    """Tracks of the boxes that count as ``name`` (video_id, frame_idx, det, track_id, cx, cy, speed), box by box, with the live tracks as state."""
    return f"""{name}_b AS (
  SELECT video_id, frame_idx, det, cx, cy, 2 * half AS w, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, det) AS rn FROM (
    SELECT CAST(year(l_shipdate) AS VARCHAR) AS video_id, CAST(dayofyear(l_shipdate) AS BIGINT) AS frame_idx, l_orderkey * 8 + l_linenumber AS det, (l_partkey % 640)::DOUBLE AS cx, (l_suppkey % 360)::DOUBLE AS cy,
           l_quantity / 2 + 8 AS half, l_linenumber % 10 AS class_id, l_discount * 5 + 0.2 AS conf FROM lineitem) WHERE conf >= 0.25 AND class_id IN (0, 1, 2, 3, 5, 7) AND {where}),
{name}_s AS (
  SELECT video_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id INT, cx DOUBLE, cy DOUBLE, seen BIGINT)[]) AS tracks, 0 AS made, CAST(NULL AS INT) AS track_id, CAST(NULL AS DOUBLE) AS speed FROM {name}_b WHERE rn = 1
  UNION ALL
  SELECT video_id, rn,
         CASE WHEN best.id IS NULL THEN list_append(live, {{'id': made + 1, 'cx': cx, 'cy': cy, 'seen': frame_idx}})
              ELSE list_transform(live, lambda t: CASE WHEN t.id = best.id THEN {{'id': t.id, 'cx': cx, 'cy': cy, 'seen': frame_idx}} ELSE t END) END,
         CASE WHEN best.id IS NULL THEN made + 1 ELSE made END,
         CASE WHEN best.id IS NULL THEN made + 1 ELSE best.id END,
         CASE WHEN best.seen < frame_idx THEN sqrt((cx - best.cx) ** 2 + (cy - best.cy) ** 2) / ((frame_idx - best.seen) / 30.0) END
  FROM (
    SELECT *, list_reduce(list_prepend({{'v': 0.0::DOUBLE, 'id': NULL::INT, 'cx': NULL::DOUBLE, 'cy': NULL::DOUBLE, 'seen': NULL::BIGINT}},
        list_transform(list_filter(live, lambda t: abs(t.cx - cx) < w AND abs(t.cy - cy) < w),
          lambda t: {{'v': (w - abs(t.cx - cx)) * (w - abs(t.cy - cy)) / (2 * w * w - (w - abs(t.cx - cx)) * (w - abs(t.cy - cy)) + 1e-8), 'id': t.id, 'cx': t.cx, 'cy': t.cy, 'seen': t.seen}})),
        lambda acc, x: CASE WHEN x.v >= 0.25 AND x.v > acc.v THEN x ELSE acc END) AS best
    FROM (SELECT s.video_id, b.rn, list_filter(s.tracks, lambda t: b.frame_idx - t.seen <= 30) AS live, s.made, b.frame_idx, b.cx, b.cy, b.w FROM {name}_s s JOIN {name}_b b ON b.video_id = s.video_id AND b.rn = s.rn + 1))),
{name} AS (SELECT video_id, frame_idx, det, track_id, cx, cy, speed FROM {name}_s JOIN {name}_b USING (video_id, rn))"""


def _joined(col: str) -> str:
    return f"array_to_string({col}, ',')"


SQL: dict[str, str] = {
    "frame_scan": "SELECT 'v' || (vec_id // 100) AS video_id, CAST(vec_id % 100 // 2 AS INT) AS frame_idx, vec_id % 100 AS src_idx, label FROM embeddings WHERE vec_id % 100 % 2 = 0",
    "video_probe": """
        SELECT doc_id AS video_id, round(CASE WHEN doc_id % 40 <= 1 THEN 24.0 WHEN doc_id % 40 BETWEEN 23.9 AND 24.1 THEN 24000.0 / 1001.0 ELSE doc_id % 40 END, 6)::DOUBLE AS fps,
               CASE WHEN n_chars % 1000 > 0 THEN CAST(ceil((n_chars % 1000) / 2.0) AS BIGINT) END AS frames_estimate FROM documents""",
    "kept_frame_scan": f"WITH {PIXELS} SELECT video_id, frame_idx, {_joined('px')} AS px FROM fr WHERE frame_idx % 7 = 0",
    "delta_map_h20": f"""
        WITH {FEATURES} SELECT a.video_id, a.frame_idx, round(coalesce(1 - max(list_dot_product(a.feat, b.feat)), 1.0), 6) AS delta_map
        FROM f a LEFT JOIN f b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx - 20 AND a.frame_idx - 1 GROUP BY 1, 2""",
    "delta_map_chunked": """
        SELECT 'v0' AS video_id, CAST(a.vec_id AS INT) AS frame_idx, round(coalesce(1 - max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1.0), 6) AS delta_map, CAST(count(b.vec_id) AS INT) AS n_context
        FROM embeddings a LEFT JOIN embeddings b ON b.vec_id BETWEEN a.vec_id - 20 AND a.vec_id - 1 GROUP BY 1, 2""",
    "novelty_uniform": f"WITH {FEATURES}, {_uniform('f', 'cx', 15, 3)} SELECT video_id, frame_idx, round(delta_map, 6) AS delta_map, round(novelty, 6) AS novelty, n_context FROM cx",
    "feature_similarity": f"""
        WITH {FEATURES}, u AS (SELECT video_id, frame_idx, list_transform(feat, lambda x: x / (sqrt(list_dot_product(feat, feat)) + 1e-8)) AS feat FROM f)
        SELECT a.video_id, a.frame_idx, round(list_dot_product(a.feat, b.feat), 6) AS similarity, round(1 - list_dot_product(a.feat, b.feat), 6) AS distance
        FROM u a JOIN u b ON a.video_id = b.video_id AND b.frame_idx = a.frame_idx - 1""",
    "oric_proxy": f"""
        WITH {FEATURES}, h AS (SELECT video_id, frame_idx, feat, least(frame_idx, 30) AS n FROM f),
        p AS (SELECT a.video_id, a.frame_idx, a.n, greatest(1, a.n // 5) AS step, a.n - (a.frame_idx - b.frame_idx) AS i, list_dot_product(a.feat, b.feat) AS s
              FROM h a LEFT JOIN h b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx - a.n AND a.frame_idx - 1)
        SELECT video_id, frame_idx, round(round(coalesce(1 - max(s), 1.0), 9), 6) AS score FROM p
        WHERE i IS NULL OR n < 3 OR (i % step = 0 AND i // step >= (n + step - 1) // step - 5) GROUP BY ALL""",
    "motion_lag": f"WITH {PIXELS}, {PIXEL_MOTION} SELECT video_id, frame_idx, round(motion, 6) AS motion FROM pm",
    "motion_baseline": f"WITH {PIXELS}, {PIXEL_MOTION} SELECT video_id, frame_idx, round(CASE WHEN frame_idx = 0 THEN 0.0 ELSE motion * 255 END, 6) AS motion FROM pm",
    "entropy_hist": f"WITH {PIXELS}, {ENTROPY} SELECT video_id, frame_idx, round(entropy, 6) AS entropy FROM en",
    "detection_names": f"""
        WITH {GRID} SELECT CAST(CASE class_id WHEN 9 THEN 99 ELSE class_id END AS INT) AS class_id, count(*) AS n,
          CASE class_id WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 8 THEN 'boat' ELSE '' END AS name
        FROM ev GROUP BY ALL""",
    "detection_carry_forward": f"WITH {GRID}, {_carried(12)} SELECT video_id, frame_idx, CAST(len(class_ids) AS INT) AS n_objects, coalesce({_joined('class_ids')}, '') AS class_ids FROM ca",
    "class_weight_rolling": f"WITH {GRID}, {_carried(12)}, {WEIGHTS} SELECT video_id, frame_idx, round(class_weight, 6) AS class_weight FROM we",
    "score_blend": f"""
        WITH {SCORED} SELECT video_id, frame_idx, round(delta_map, 6) AS delta_map, round(novelty, 6) AS novelty, round(motion, 6) AS motion, round(class_weight, 6) AS class_weight,
               n_objects, n_context, round(semantic, 6) AS semantic, round(score, 6) AS score FROM sc""",
    "score_stats": f"""
        WITH {PRICES} SELECT video_id, round(min(score), 6) AS min, round(max(score), 6) AS max, round(median(score), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90,
               round(avg(CASE WHEN score < 1e-4 THEN 1.0 ELSE 0.0 END), 6) AS frac_below_1e4, round(avg(CASE WHEN score > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS frac_above_001
        FROM ps GROUP BY ALL""",
    "calibrate_tau": f"WITH {PRICES} SELECT video_id, round(quantile_cont(score, 0.8), 6) AS tau FROM ps GROUP BY ALL",
    "adaptive_tau": f"WITH {PRICES}, {_tau('ps', 'ta', 1.0, 0.45, 0.72)} SELECT video_id, round(tau, 6) AS tau FROM ta",
    "busy_information": f"WITH {GRID}, {_carried(12)}, {MOTION}, {_rich(2)} SELECT video_id, n, round(busy, 6) AS busy, round(information, 6) AS information FROM ri",
    "adaptive_bounds": f"WITH {GRID}, {_carried(8)}, {MOTION}, {_rich(3)}, {_bounds('information', 0.15, 0.55, 0.30, 0.82, 0.85)} SELECT * FROM bo",
    "topk_target_ratio": f"""
        WITH {PRICES}, ta AS (SELECT video_id, quantile_cont(score, 0.8) AS tau, greatest(1, round_even(count(*) * 0.2, 0)) AS k FROM ps GROUP BY ALL)
        SELECT video_id, frame_idx, round(score, 7) AS score, round(tau, 6) AS tau FROM ps JOIN ta USING (video_id)
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) <= k""",
    "threshold_keep": f"""
        WITH {PRICES}, ta AS (SELECT video_id, quantile_cont(score, 0.8) AS tau FROM ps GROUP BY ALL)
        SELECT video_id, count(*) AS n, round(min(score), 7) AS lowest FROM ps JOIN ta USING (video_id) WHERE score > round(tau, 9) GROUP BY ALL""",
    "adaptive_select": f"""
        WITH {SCORED}, {_rich(2)}, {_bounds('busy', 0.12, 0.38, 0.35, 0.62, 0.70)}, {_tau('sc', 'ta', 1.2, 0.45, 0.68)},
        ab AS (SELECT video_id, tau, count(*) FILTER (score > round(tau, 9)) AS above FROM sc JOIN ta USING (video_id) GROUP BY ALL),
        -- the linear quantile at 1 - soft_n / n
        qs AS (SELECT video_id, list(score ORDER BY score) AS s, any_value(soft_n) AS soft_n, any_value(n) AS n FROM sc JOIN bo USING (video_id) GROUP BY ALL),
        qp AS (SELECT *, round((1 - soft_n / n) * (n - 1), 9) AS p FROM qs),
        qt AS (SELECT video_id, CASE WHEN p = floor(p) THEN s[CAST(p AS INT) + 1] ELSE s[CAST(floor(p) AS INT) + 1] * (1 - (p - floor(p))) + s[CAST(floor(p) AS INT) + 2] * (p - floor(p)) END AS tau2 FROM qp)
        SELECT video_id, frame_idx, round(score, 6) AS score, round(CASE WHEN above < soft_n THEN tau2 ELSE tau END, 6) AS tau
        FROM sc JOIN bo USING (video_id) JOIN ab USING (video_id) JOIN qt USING (video_id)
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) <= greatest(above, soft_n)""",
    "motion_gate": f"""
        WITH {PIXELS}, {PIXEL_MOTION}, li AS (SELECT video_id, quantile_cont(motion, 0.65) AS lim FROM pm GROUP BY ALL),
        dm AS (SELECT a.video_id, a.frame_idx, round(coalesce(1 - max(list_dot_product(a.feat, b.feat)), 1.0), 9) AS d
               FROM f a LEFT JOIN f b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx - 20 AND a.frame_idx - 1 GROUP BY 1, 2)
        SELECT video_id, frame_idx, round(CASE WHEN c THEN d ELSE m END, 6) AS score, c AS candidate
        FROM (SELECT video_id, frame_idx, round(motion, 9) AS m, round(motion, 9) >= round(lim, 9) OR frame_idx % 6 = 0 AS c FROM pm JOIN li USING (video_id)) JOIN dm USING (video_id, frame_idx)""",
    "uniform_keep": f"WITH {FEATURES} SELECT video_id, frame_idx FROM f WHERE frame_idx % 5 = 0",
    "non_uniform_keep": f"WITH {NON_UNIFORM} SELECT video_id, frame_idx, round(score, 6) AS score FROM nk",
    "kept_overlap": f"""
        WITH {NON_UNIFORM}, uk AS (SELECT video_id, frame_idx FROM fr WHERE frame_idx % 5 = 0),
        al AS (SELECT video_id, frame_idx FROM nk UNION SELECT video_id, frame_idx FROM uk),
        ma AS (SELECT video_id, (video_id, frame_idx) IN (SELECT (video_id, frame_idx) FROM nk) AS a, (video_id, frame_idx) IN (SELECT (video_id, frame_idx) FROM uk) AS b FROM al)
        SELECT video_id, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard
        FROM ma GROUP BY ALL""",
    "kept_frame_sink": f"WITH {PIXELS} SELECT video_id, CAST(frame_idx // 10 AS INT) AS frame_idx, {_joined('px')} AS px FROM fr WHERE frame_idx % 10 = 0",
    "materialised_scan": f"WITH {PIXELS} SELECT video_id, count(*) AS n, round(avg(list_sum(px) / 64.0), 6) AS mean_level FROM fr GROUP BY ALL",
    "resize_frames": f"""
        WITH {PIXELS}, pc AS (SELECT video_id, frame_idx, p, px[p + 1] AS v FROM (SELECT *, unnest(range(64)) AS p FROM fr)), {_shrunk(16, 4, 14, 4)}
        SELECT video_id, frame_idx, string_agg(v, ',' ORDER BY y, x) AS px, 14::INT AS height, 4::INT AS width, true AS scaled FROM rs GROUP BY ALL""",
    "resize_truncating": f"""
        WITH {PIXELS}, pc AS (SELECT video_id, frame_idx, p, px[p + 1] AS v FROM (SELECT *, unnest(range(64)) AS p FROM fr)), {_shrunk(16, 4, 14, 3)}
        SELECT video_id, frame_idx, string_agg(v, ',' ORDER BY y, x) AS px, 14::INT AS height, 3::INT AS width FROM rs GROUP BY ALL""",
    "gray_thumbnail": f"""
        WITH {COLOURS}, pc AS (SELECT video_id, frame_idx, p, round_even(round(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 9), 0) AS v FROM cl), {_shrunk(8, 8, 4, 4)}
        SELECT video_id, frame_idx, string_agg(v, ',' ORDER BY y, x) AS px FROM rs GROUP BY ALL""",
    "rgb_order": f"WITH {COLOURS} SELECT video_id, frame_idx, string_agg(r || ',' || g || ',' || b, ',' ORDER BY p) AS px FROM cl GROUP BY ALL",
    "dilate_labels": f"""
        WITH {LABELS}, lp AS (SELECT video_id, frame_idx, p // 8 AS y, p % 8 AS x, labels[p + 1] AS l FROM (SELECT *, unnest(range(64)) AS p FROM lf)),
        dl AS (SELECT a.video_id, a.frame_idx, a.y, a.x, max(b.l) AS l FROM lp a JOIN lp b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
        SELECT video_id, frame_idx, string_agg(l, ',' ORDER BY y, x) AS labels FROM dl GROUP BY ALL""",
    "content_aware": f"""
        WITH RECURSIVE {PIXELS}, gg AS (SELECT video_id, frame_idx, px AS g FROM fr), {_canny('ed', 'gg', 50, 150)},
        de AS (SELECT fr.video_id, fr.frame_idx, round(count(p) / 64.0, 9) AS score FROM fr LEFT JOIN ed USING (video_id, frame_idx) GROUP BY ALL)
        SELECT video_id, frame_idx, round(score, 6) AS score FROM de
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) <= greatest(1, round_even(count(*) OVER (PARTITION BY video_id) * 0.2, 0))""",
    "soft_edge_frames": f"""
        WITH RECURSIVE {COLOURS}, gg AS (SELECT video_id, frame_idx, list(CAST(round_even(round(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 9), 0) AS INT) ORDER BY p) AS g FROM cl GROUP BY ALL),
        {_canny('ed', 'gg', 60, 150)}, pal(k, pr, pg, pb) AS (VALUES {_PALETTE_ROWS}),
        nn AS (SELECT video_id, frame_idx, p, arg_min(k, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 100 + k) AS k FROM cl CROSS JOIN pal GROUP BY ALL),
        gr AS (SELECT DISTINCT nn.video_id, nn.frame_idx, nn.p FROM nn JOIN ed ON ed.video_id = nn.video_id AND ed.frame_idx = nn.frame_idx AND abs(nn.p // 8 - ed.y) <= 1 AND abs(nn.p % 8 - ed.x) <= 1)
        SELECT video_id, frame_idx, string_agg(CASE WHEN gr.p IS NULL THEN 0 ELSE k + 1 END, ',' ORDER BY p) AS labels FROM nn LEFT JOIN gr USING (video_id, frame_idx, p) GROUP BY ALL""",
    "class_count_map": f"""
        WITH {GRID}, cc AS (SELECT video_id, class_id, count(*) AS n FROM ev GROUP BY ALL)
        SELECT video_id, CAST(count(*) AS INT) AS classes, '{{' || string_agg('"' || class_id || '":' || n, ',' ORDER BY class_id::VARCHAR) || '}}' AS counts FROM cc GROUP BY ALL""",
    "gated_sampling": f"""
        WITH {GATED}, ta AS (SELECT video_id, quantile_cont(score, 0.8) AS tau, greatest(1, round_even(count(*) * 0.2, 0)) AS k FROM gs GROUP BY ALL)
        SELECT video_id, frame_idx, round(score, 6) AS score, round(tau, 6) AS tau FROM gs JOIN ta USING (video_id)
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) <= k""",
    "online_selection": f"""
        WITH {NON_UNIFORM}, wu AS (SELECT *, row_number() OVER w AS rn, median(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mid FROM nu WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
        ot AS (SELECT video_id, quantile_cont(score, 0.8) AS tau FROM wu WHERE rn <= 30 GROUP BY ALL)
        SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, round(score, 6) AS score, CASE WHEN rn < 30 THEN score >= mid ELSE score > tau END AS kept, CASE WHEN rn >= 30 THEN round(tau, 6) END AS tau
        FROM wu JOIN ot USING (video_id)""",
    "gap_topk": f"""
        WITH RECURSIVE {NON_UNIFORM}, ra AS (
          SELECT video_id, frame_idx, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY video_id) * 0.3, 0)) AS keep FROM nu),
        st AS (
          SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS rn, CAST([] AS INT[]) AS chosen FROM ra
          UNION ALL
          SELECT st.video_id, ra.rn, CASE WHEN len(chosen) < keep AND len(list_filter(chosen, lambda c: abs(c - ra.frame_idx) < 4)) = 0 THEN list_append(chosen, ra.frame_idx) ELSE chosen END
          FROM st JOIN ra ON ra.video_id = st.video_id AND ra.rn = st.rn + 1),
        fi AS (SELECT video_id, chosen FROM st QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY rn DESC) = 1),
        ma AS (SELECT ra.*, list_contains(chosen, ra.frame_idx) AS own FROM ra JOIN fi USING (video_id))
        SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, round(score, 6) AS score FROM ma QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY own DESC, rn) <= keep""",
    "diverse_topk": f"""
        WITH RECURSIVE {NON_UNIFORM}, si AS (SELECT a.video_id, a.frame_idx AS i, b.frame_idx AS j, list_dot_product(a.feat, b.feat) AS s FROM f a JOIN f b USING (video_id)),
        sl AS (SELECT video_id, i, list(s ORDER BY j) AS sims FROM si GROUP BY ALL),
        al AS (SELECT nu.video_id, list({{'i': nu.frame_idx, 's': score, 'sims': sims}} ORDER BY nu.frame_idx) AS frames, greatest(1, round_even(count(*) * 0.2, 0)) AS keep
               FROM nu JOIN sl ON sl.video_id = nu.video_id AND sl.i = nu.frame_idx GROUP BY ALL),
        st AS (
          SELECT video_id, CAST([] AS INT[]) AS chosen, 4 AS gap FROM al
          UNION ALL
          SELECT video_id, CASE WHEN best IS NULL THEN chosen ELSE list_append(chosen, best) END, CASE WHEN best IS NULL THEN gap - 1 ELSE gap END
          FROM (
            SELECT st.video_id, chosen, gap, list_reduce(list_prepend({{'w': -1e9::DOUBLE, 'i': NULL::INT}}, list_transform(
                list_filter(frames, lambda x: len(list_filter(chosen, lambda c: abs(c - x.i) < gap)) = 0),
                lambda x: {{'w': x.s - CASE WHEN len(chosen) = 0 THEN 0.0 ELSE 0.45 * list_max(list_transform(chosen, lambda c: x.sims[c + 1])) END, 'i': x.i}})),
              lambda acc, x: CASE WHEN x.w > acc.w THEN x ELSE acc END).i AS best
            FROM st JOIN al USING (video_id) WHERE len(chosen) < keep AND gap >= 1)),
        fi AS (SELECT video_id, chosen FROM st QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY len(chosen) DESC) = 1)
        SELECT nu.video_id, CAST(nu.frame_idx AS BIGINT) AS frame_idx, round(score, 6) AS score FROM nu JOIN fi ON fi.video_id = nu.video_id AND list_contains(chosen, nu.frame_idx)""",
    "hybrid_stream": f"""
        WITH {LABELS} SELECT video_id, frame_idx, CASE WHEN frame_idx % 10 = 0 THEN 'K' ELSE 'E' END AS tag, CASE WHEN frame_idx % 10 = 0 THEN {_joined('px')} ELSE {_joined('labels')} END AS content
        FROM lf JOIN fr USING (video_id, frame_idx)""",
    "rgb_only_playback": f"WITH {BETWEEN_KEYS} SELECT video_id, frame_idx, {_joined('px')} AS px FROM ki",
    "hybrid_blend": f"""
        WITH {PIXELS} SELECT a.video_id, a.frame_idx, array_to_string(CASE WHEN a.frame_idx % 10 = 0 THEN a.px ELSE
          list_transform(list_zip(a.px, b.px), lambda p: CAST(greatest(0, least(255, floor(round(p[1] * 0.75 + p[2] * 0.25, 6)))) AS INT)) END, ',') AS px
        FROM fr a JOIN fr b ON a.video_id = b.video_id AND b.frame_idx = a.frame_idx // 10 * 10""",
    "residual_blend": f"""
        WITH {BETWEEN_KEYS} SELECT ki.video_id, ki.frame_idx, array_to_string(list_transform(list_zip(ki.px, fr.px), lambda p: CAST(greatest(0, least(255, floor(round(p[1] + (p[2] - p[1]) * 0.25, 6)))) AS INT)), ',') AS px
        FROM ki JOIN fr USING (video_id, frame_idx)""",
    "combo_report": f"""
        WITH {COMBO} SELECT video_id, n_total, n_kept, n_kept + 6 * coalesce(pixels, 0) AS coded_bytes, round((1 - (n_kept + 6 * coalesce(pixels, 0)) / (n_total * 64)) * 100, 6) AS saving_pct,
               round(n_total * 64 * 8 / 1e7, 9) AS tx_source_s, round((n_kept + 6 * coalesce(pixels, 0)) * 8 / 1e7, 9) AS tx_coded_s
        FROM (SELECT video_id, count(*) AS n_total FROM lf GROUP BY ALL) JOIN (SELECT video_id, count(*) AS n_kept FROM ko GROUP BY ALL) USING (video_id)
        LEFT JOIN (SELECT video_id, count(*) AS pixels FROM kt GROUP BY ALL) USING (video_id)""",
    "combo_decoded": f"WITH {COMBO} SELECT video_id, frame_idx, src_idx, {_joined('labels')} AS labels FROM ko",
    "compression_summary": f"""
        WITH {TRIPLES}, sz AS (SELECT video_id, n, coalesce(pixels, 0) * 6 AS c, floor(n * 997 * (n / 120)) AS o
          FROM (SELECT video_id, count(*) AS n FROM lf GROUP BY ALL) LEFT JOIN (SELECT video_id, count(*) AS pixels FROM tr GROUP BY ALL) USING (video_id))
        SELECT video_id, n AS n_frames, round(o / 1048576.0, 6) AS original_mb, round(c / 1048576.0, 6) AS compressed_mb, round((1 - c / o) * 100, 6) AS saving_pct FROM sz""",
    "ssim_windowed": f"""
        WITH {BETWEEN_KEYS}, pr AS (SELECT fr.video_id, fr.frame_idx, p // 8 AS y, p % 8 AS x, CAST(fr.px[p + 1] AS DOUBLE) AS a, CAST(ki.px[p + 1] AS DOUBLE) AS b
          FROM fr JOIN ki USING (video_id, frame_idx), (SELECT range AS p FROM range(64))),
        wi AS (SELECT video_id, frame_idx, oy, ox, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c
          FROM pr, (SELECT range AS oy FROM range(2)), (SELECT range AS ox FROM range(2)) WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL)
        SELECT video_id, frame_idx, round(avg((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 6) AS ssim FROM wi GROUP BY ALL""",
    "ema_smooth": f"""
        WITH RECURSIVE {PIXELS}, mi AS (
          SELECT video_id, frame_idx, list_transform(range(1, 65), lambda i: CASE WHEN p1 IS NULL THEN px[i]::FLOAT
              WHEN p2 IS NULL THEN floor(greatest(0::FLOAT, least(255::FLOAT, p1[i]::FLOAT * 0.55::FLOAT + px[i]::FLOAT * 0.45::FLOAT)))::FLOAT
              ELSE floor(greatest(0::FLOAT, least(255::FLOAT, (p2[i]::FLOAT * 0.55::FLOAT + p1[i]::FLOAT * 0.45::FLOAT) * 0.55::FLOAT + px[i]::FLOAT * 0.45::FLOAT)))::FLOAT END) AS m
          FROM (SELECT *, lag(px) OVER w AS p1, lag(px, 2) OVER w AS p2 FROM fr WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))),
        sm AS (
          SELECT video_id, frame_idx, m FROM mi WHERE frame_idx = 0
          UNION ALL
          SELECT mi.video_id, mi.frame_idx, list_transform(list_zip(mi.m, sm.m), lambda p: floor(greatest(0::FLOAT, least(255::FLOAT,
            p[1] * (1::FLOAT - CASE WHEN mi.frame_idx % 30 = 0 THEN 0.36::FLOAT ELSE 0.3::FLOAT END) + p[2] * CASE WHEN mi.frame_idx % 30 = 0 THEN 0.36::FLOAT ELSE 0.3::FLOAT END)))::FLOAT)
          FROM sm JOIN mi ON mi.video_id = sm.video_id AND mi.frame_idx = sm.frame_idx + 1)
        SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, array_to_string(list_transform(m, lambda v: v::INT), ',') AS px FROM sm""",
    "box_overlap": """
        WITH b AS (
          SELECT CAST(year(l_shipdate) AS VARCHAR) AS video_id, dayofyear(l_shipdate) AS frame_idx, l_orderkey * 8 + l_linenumber AS det, (l_partkey % 640)::DOUBLE AS cx, (l_suppkey % 360)::DOUBLE AS cy, l_quantity / 2 + 8 AS half FROM lineitem),
        p AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(half) OVER w AS ph FROM b WINDOW w AS (PARTITION BY video_id, frame_idx ORDER BY det, cx - half, cy - half, cx + half)),
        o AS (SELECT *, greatest(0.0, least(cx + half, px + ph) - greatest(cx - half, px - ph)) * greatest(0.0, least(cy + half, py + ph) - greatest(cy - half, py - ph)) AS ov FROM p WHERE px IS NOT NULL)
        SELECT video_id, det, round(CASE WHEN ov <= 0 THEN 0.0 ELSE ov / (4 * half * half + 4 * ph * ph - ov + 1e-8) END, 6) AS iou FROM o""",
    "delta_encode": f"WITH {TRIPLES} SELECT video_id, frame_idx, CAST(y AS INT) AS y, CAST(x AS INT) AS x, label FROM tr",
    "delta_decode": f"WITH {LABELS} SELECT video_id, frame_idx, {_joined('labels')} AS labels FROM lf",
    "packet_sizes": f"""
        WITH {TRIPLES} SELECT video_id, n_frames, pixels, pixels * 6 AS compressed_bytes
        FROM (SELECT video_id, count(*) AS n_frames FROM lf GROUP BY ALL) JOIN (SELECT video_id, count(*) AS pixels FROM tr GROUP BY ALL) USING (video_id)""",
    "bitstream_round_trip": f"""
        WITH {TRIPLES} SELECT lf.video_id, lf.frame_idx, '45' || coalesce(string_agg(printf('%02X00%02X00%02X00', y, x, label), '' ORDER BY y, x), '') AS payload, 30 AS "interval"
        FROM lf LEFT JOIN tr USING (video_id, frame_idx) GROUP BY ALL""",
    "storage_downscale": f"WITH {LABELS} SELECT video_id, frame_idx, {_joined('list_transform(range(16), lambda i: labels[1 + (i // 4) * 16 + (i % 4) * 2])')} AS labels FROM lf",
    "palette_assign": f"""
        WITH {PIXELS}, pal(k, pr, pg, pb) AS (VALUES {_PALETTE_ROWS}),
        pt AS (SELECT video_id, frame_idx, CAST(p AS INT) AS p, px[(p + 42) % 64 + 1] AS r, px[(p + 21) % 64 + 1] AS g, px[p + 1] AS b FROM (SELECT *, unnest(range(64)) AS p FROM fr)),
        nn AS (SELECT video_id, frame_idx, p, arg_min(k, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 100 + k) AS k FROM pt CROSS JOIN pal GROUP BY ALL)
        SELECT video_id, frame_idx, p, CAST(nn.k + 1 AS INT) AS label, CAST(pr AS INT) AS soft_r, CAST(pg AS INT) AS soft_g, CAST(pb AS INT) AS soft_b FROM nn JOIN pal USING (k)""",
    "key_interp_linear": f"WITH {BETWEEN_KEYS} SELECT video_id, frame_idx, {_joined('px')} AS px FROM ki",
    "psnr_ssim": f"WITH {QUALITY} SELECT video_id, frame_idx, round(psnr, 6) AS psnr, round(ssim, 6) AS ssim FROM qu",
    "mean_quality": f"WITH {QUALITY} SELECT video_id, round(avg(psnr), 6) AS psnr, round(avg(ssim), 6) AS ssim FROM qu GROUP BY ALL",
    "temporal_stack": f"""
        WITH {LABELS}, a AS (SELECT video_id, frame_idx, {_joined('labels')} AS l FROM lf)
        SELECT a.video_id, a.frame_idx, c.l || ',' || b.l || ',' || a.l AS stack FROM a
        JOIN a b ON b.video_id = a.video_id AND b.frame_idx = greatest(0, a.frame_idx - 1) JOIN a c ON c.video_id = a.video_id AND c.frame_idx = greatest(0, a.frame_idx - 2)""",
    "tx_time_report": """
        WITH s AS (SELECT doc_id AS video_id, n_chars AS o, floor(n_chars * 0.25) AS c FROM documents)
        SELECT video_id, round(o / 1048576.0, 6) AS original_mb, round(c / 1048576.0, 6) AS compressed_mb, CASE WHEN o = 0 THEN 0.0 ELSE round((1 - c / o) * 100, 6) END AS saving_pct,
               round(o * 8 / 1e7, 9) AS tx_original_s, round(c * 8 / 1e7, 9) AS tx_compressed_s FROM s""",
    "manifest": f"""
        WITH {NON_UNIFORM} SELECT video_id, 'non_uniform' AS method, string_agg(frame_idx, ',' ORDER BY frame_idx) AS indices, n AS n_total, count(*) AS n_kept, round(count(*) / n, 6) AS retention_ratio
        FROM nk JOIN (SELECT video_id, count(*) AS n FROM fr GROUP BY ALL) USING (video_id) GROUP BY video_id, n""",
    "manifest_json": f"""
        WITH {NON_UNIFORM} SELECT video_id, '{{"method":"non_uniform","indices":[' || string_agg(frame_idx, ',' ORDER BY frame_idx) || '],"n_total":' || n || ',"n_kept":' || count(*) || ',"retention_ratio":' || (count(*) / n) || '}}' AS json
        FROM nk JOIN (SELECT video_id, count(*) AS n FROM fr GROUP BY ALL) USING (video_id) GROUP BY video_id, n""",
    "debug_overlay": f"""
        WITH {NON_UNIFORM}, st AS (SELECT nu.video_id, nu.frame_idx, nu.score, CASE WHEN nk.frame_idx IS NULL THEN 'SKIP' ELSE 'KEEP' END AS state FROM nu LEFT JOIN nk USING (video_id, frame_idx))
        SELECT video_id, frame_idx, state, printf('%s #%d  score=%.2e', state, frame_idx, score) AS caption FROM st""",
    "tracker": f"WITH RECURSIVE {_tracks('tk')} SELECT video_id, frame_idx, det, track_id, cx, cy, round(speed, 6) AS speed FROM tk",
    "traffic_fidelity": f"""
        WITH RECURSIVE {_tracks('ta')}, {_tracks('th', 'frame_idx % 2 = 0')},
        sa AS (SELECT video_id, count(DISTINCT track_id) AS n, coalesce(avg(speed), 0.0) AS mean, coalesce(max(speed), 0.0) AS most FROM ta GROUP BY ALL),
        sh AS (SELECT video_id, count(DISTINCT track_id) AS n, coalesce(avg(speed), 0.0) AS mean, coalesce(max(speed), 0.0) AS most FROM th GROUP BY ALL)
        SELECT video_id, round(coalesce(sh.n, 0) / sa.n * 100, 6) AS id_retention_pct, round(abs(coalesce(sh.mean, 0) - sa.mean) / (sa.mean + 1e-8) * 100, 6) AS avg_speed_error_pct,
               round(abs(coalesce(sh.most, 0) - sa.most) / (sa.most + 1e-8) * 100, 6) AS max_speed_error_pct
        FROM sa LEFT JOIN sh USING (video_id)""",
    "traffic_boxes": f"WITH {TRACKED} SELECT video_id, class_id, count(*) AS n FROM bx WHERE conf >= 0.25 AND class_id IN (0, 1, 2, 3, 5, 7) AND frame_idx % 2 = 0 GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
