"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..operators.batch import PRESETS, TIERS, settings


def _level(turn: int) -> str:
    return f"CAST(least(255, greatest(0, floor((CAST(embedding[(x + {turn}) % 64 + 1] AS DOUBLE) + 0.5::DOUBLE) * 255))) AS INT)"


PX = f"""px AS (
  SELECT vec_id // 50 AS image_id, CAST(vec_id % 50 AS INT) AS y, CAST(x AS INT) AS x, {_level(0)} AS r, {_level(21)} AS g, {_level(42)} AS b,
    CASE WHEN (x + vec_id % 50) % 11 = 0 THEN 40 ELSE 255 END AS a
  FROM embeddings, range(64) t(x) WHERE len(embedding) = 64)"""
LABELS = "lb AS (SELECT *, r // 32 + 1 AS label FROM px)"
LUMA = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
PACKED = "(((r >> 3) << 10) + ((g >> 3) << 5) + (b >> 3))"


def q(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join((PX, *ctes)) + "\n" + select


def block(value: str, name: str = "bl") -> str:
    """The nine values around each pixel with the edge pixel again beyond the border."""
    return f"""{name} AS (
  SELECT p.image_id, p.y, p.x, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, any_value(p.a) AS a,
    list(n.v ORDER BY dy, dx) AS v
  FROM (SELECT *, max(y) OVER (PARTITION BY image_id) AS h, max(x) OVER (PARTITION BY image_id) AS w FROM px) p, (VALUES (-1), (0), (1)) i(dy), (VALUES (-1), (0), (1)) j(dx),
    LATERAL (SELECT {value} AS v FROM px o WHERE o.image_id = p.image_id AND o.y = least(p.h, greatest(0, p.y + dy)) AND o.x = least(p.w, greatest(0, p.x + dx))) n
  GROUP BY p.image_id, p.y, p.x)"""


SOBEL = "sqrt((v[3] + 2 * v[6] + v[9] - v[1] - 2 * v[4] - v[7]) ** 2 + (v[7] + 2 * v[8] + v[9] - v[1] - 2 * v[2] - v[3]) ** 2)"
BORDER = """sz AS (SELECT image_id, max(y) AS h, max(x) AS w FROM px GROUP BY image_id), ed AS (
  SELECT px.* FROM px JOIN sz USING (image_id) WHERE y = 0 UNION ALL SELECT px.* FROM px JOIN sz USING (image_id) WHERE y = h
  UNION ALL SELECT px.* FROM px JOIN sz USING (image_id) WHERE x = 0 UNION ALL SELECT px.* FROM px JOIN sz USING (image_id) WHERE x = w),
mid AS (SELECT image_id, CAST(quantile_cont(r, 0.5) AS DOUBLE) AS mr, CAST(quantile_cont(g, 0.5) AS DOUBLE) AS mg, CAST(quantile_cont(b, 0.5) AS DOUBLE) AS mb FROM ed GROUP BY image_id)"""
KERNELS = {
    "lanczos": (3, "CASE WHEN t = 0 THEN 1.0 WHEN abs(t) >= 3 THEN 0.0 ELSE 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t) ** 2 END"),
    "bilinear": (1, "greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(t))"),
    "bicubic": (2, "CASE WHEN abs(t) < 1 THEN 1.5::DOUBLE * abs(t) ** 3 - 2.5::DOUBLE * t ** 2 + 1 WHEN abs(t) < 2 THEN -0.5::DOUBLE * abs(t) ** 3 + 2.5::DOUBLE * t ** 2 - 4 * abs(t) + 2 ELSE 0.0::DOUBLE END"),
}


def _weights(name: str, n_in: int, n_out: int, method: str) -> str:
    reach, kernel = KERNELS[method]
    scale, wide = n_in / n_out, max(1, n_in / n_out)
    return f"""{name} AS (SELECT s, o, k / sum(k) OVER (PARTITION BY o) AS w FROM (SELECT s, o, CAST({kernel} AS DOUBLE) AS k FROM (
  SELECT CAST(s AS INT) AS s, CAST(o AS INT) AS o, (s + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {scale}::DOUBLE) / {wide}::DOUBLE AS t FROM range({n_in}) a(s), range({n_out}) b(o)
  WHERE s >= floor((o + 0.5::DOUBLE) * {scale}::DOUBLE - {reach * wide} + 0.5::DOUBLE) AND s < floor((o + 0.5::DOUBLE) * {scale}::DOUBLE + {reach * wide} + 0.5::DOUBLE))))"""


def resized(width: int, height: int, method: str) -> str:
    """The rasters of 64 x 50 pixels in another size."""
    level = lambda c: f"CAST(least(255, greatest(0, floor(round(sum({c} * w), 6) + 0.5::DOUBLE))) AS INT) AS {c}"
    levels = ", ".join(map(level, "rgba"))
    pre = ", ".join(f"floor({c} * a / 255.0::DOUBLE + 0.5::DOUBLE) AS {c}" for c in "rgb")
    post = ", ".join(f"CASE WHEN a = 0 THEN 0 ELSE CAST(least(255, ({c} * 255) // greatest(a, 1)) AS INT) END AS {c}" for c in "rgb")
    return q(_weights("wx", 64, width, method), _weights("wy", 50, height, method), f"pm AS (SELECT image_id, y, x, {pre}, a FROM px)",
        f"ax AS (SELECT image_id, y, o AS x, {levels} FROM pm JOIN wx ON s = x GROUP BY image_id, y, o)",
        f"dn AS (SELECT image_id, o AS y, x, {levels} FROM ax JOIN wy ON s = y GROUP BY image_id, o, x)", select=f"SELECT image_id, y, x, {post}, a FROM dn")


def ssim() -> str:
    """Every raster beside itself in eight levels a channel: moments of the windows, then the similarity."""
    long = " UNION ALL ".join(f"SELECT image_id, '{c}' AS c, y, x, {c} * (a / 255.0::DOUBLE) AS p, ({c} // 32 * 32 + 16) * (a / 255.0::DOUBLE) AS q FROM px" for c in "rgb")
    moments = "count(*) AS n, avg(q.p) AS mp, avg(q.q) AS mq, var_samp(q.p) AS vp, var_samp(q.q) AS vq, covar_samp(q.p, q.q) AS pq"
    return q(f"lg AS ({long})", f"mo AS (SELECT m.image_id, m.c, m.y, m.x, {moments} FROM lg m, range(-3, 4) i(dy), range(-3, 4) j(dx) JOIN lg q ON q.image_id = m.image_id AND q.c = m.c AND q.y = m.y + dy AND q.x = m.x + dx GROUP BY ALL HAVING n = 49)",
        select="SELECT image_id, round(avg((2 * mp * mq + 6.5025::DOUBLE) * (2 * pq + 58.5225::DOUBLE) / ((mp * mp + mq * mq + 6.5025::DOUBLE) * (vp + vq + 58.5225::DOUBLE))), 6) AS ssim FROM mo GROUP BY image_id")


SHIFTS = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx)"
ADJACENT = f"""ad AS (SELECT DISTINCT p.image_id, least(p.label, o.label) AS lo, greatest(p.label, o.label) AS hi
  FROM lb p, {SHIFTS} JOIN lb o ON o.image_id = p.image_id AND o.y = p.y + dy AND o.x = p.x + dx WHERE p.label <> o.label)"""
SYMMETRIC = "sy AS (SELECT image_id, lo AS node, hi AS other FROM ad UNION ALL SELECT image_id, hi, lo FROM ad)"


def summary(of: str, key: str) -> str:
    return f"""st AS (SELECT image_id, {key}, count(*) AS area, min(y) AS "top", max(y) + 1 AS bottom, min(x) AS "left", max(x) + 1 AS "right",
  round(avg(CAST(r AS DOUBLE)), 6) AS mean_r, round(avg(CAST(g AS DOUBLE)), 6) AS mean_g, round(avg(CAST(b AS DOUBLE)), 6) AS mean_b FROM {of} WHERE {key} > 0 GROUP BY image_id, {key})"""


CONTRAST = """co AS (SELECT s.image_id, s.label, s.area, round(c.far, 6) AS contrast, round(s.area * c.far, 6) AS worth FROM st s LEFT JOIN (
  SELECT sy.image_id, sy.node, min(sqrt((p.mean_r - q.mean_r) ** 2 + (p.mean_g - q.mean_g) ** 2 + (p.mean_b - q.mean_b) ** 2)) AS far
  FROM sy JOIN st p ON p.image_id = sy.image_id AND p.label = node JOIN st q ON q.image_id = sy.image_id AND q.label = other GROUP BY ALL) c ON c.image_id = s.image_id AND c.node = s.label)"""


def flood(of: str, name: str = "cp") -> tuple[str, ...]:
    """Components of equal non-zero labels by closure over neighbours, numbered by their first pixel."""
    return (
        f"nb AS (SELECT p.image_id, p.y * 64 + p.x AS src, o.y * 64 + o.x AS dst FROM {of} p, {SHIFTS} JOIN {of} o ON o.image_id = p.image_id AND o.y = p.y + dy AND o.x = p.x + dx WHERE p.label = o.label AND p.label <> 0)",
        f"re AS (SELECT image_id, y * 64 + x AS root, y * 64 + x AS pix FROM {of} WHERE label <> 0 UNION SELECT re.image_id, root, dst FROM re JOIN nb ON nb.image_id = re.image_id AND src = pix)",
        f"{name} AS (SELECT l.*, COALESCE(c.component, 0) AS component FROM {of} l LEFT JOIN (SELECT image_id, pix, dense_rank() OVER (PARTITION BY image_id ORDER BY least_root) AS component FROM (SELECT image_id, pix, min(root) AS least_root FROM re GROUP BY image_id, pix)) c ON c.image_id = l.image_id AND pix = l.y * 64 + l.x)",
    )


RINGS = "rg AS (SELECT image_id, y AS ring, x AS seq, CAST(r AS DOUBLE) AS x, CAST(g AS DOUBLE) AS y FROM px)"


def around(of: str, reach: int, name: str) -> str:
    return f"""{name} AS (SELECT p.image_id, p.ring, p.seq, p.x, p.y, b.x AS bx, b.y AS cy, f.x AS fx, f.y AS fy FROM {of} p
  JOIN {of} b ON b.image_id = p.image_id AND b.ring = p.ring AND b.seq = (p.seq + 64 - {reach}) % 64 JOIN {of} f ON f.image_id = p.image_id AND f.ring = p.ring AND f.seq = (p.seq + {reach}) % 64)"""


def eased(of: str, name: str) -> str:
    return f"{name} AS (SELECT image_id, ring, seq, bx * 0.25::DOUBLE + x * 0.5::DOUBLE + fx * 0.25::DOUBLE AS x, cy * 0.25::DOUBLE + y * 0.5::DOUBLE + fy * 0.25::DOUBLE AS y FROM {of})"


def _linear(c: str) -> str:
    v = f"({c} / 255.0::DOUBLE)"
    return f"(CASE WHEN {v} > 0.04045::DOUBLE THEN pow(({v} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {v} / 12.92::DOUBLE END)"


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856::DOUBLE THEN pow({t}, 1.0::DOUBLE / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116.0::DOUBLE END)"


LAB = (
    f"li AS (SELECT image_id, y, x, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM px)",
    "xy AS (SELECT image_id, y, x, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.95047::DOUBLE AS cx, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS cy, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.08883::DOUBLE AS cz FROM li)",
)
_TRIM = "regexp_replace(regexp_replace({0}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_SETTINGS = sorted(settings("icon"))


def _literal(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}::INT"


SQL = {
    "raster_pixels": q(select="SELECT * FROM px"),
    "pixel_projections": q(select=f"SELECT image_id, y, x, {PACKED} AS packed, round({LUMA}, 6) AS luma, round(r * (a / 255.0::DOUBLE) + 160.0::DOUBLE * (1.0::DOUBLE - a / 255.0::DOUBLE), 6) AS flat_r, round(g * (a / 255.0::DOUBLE), 6) AS pre_g, round((x + 0.5::DOUBLE) / 3.0::DOUBLE, 6) AS sub_x, round((y + 0.5::DOUBLE) / 3.0::DOUBLE, 6) AS sub_y FROM px"),
    "rgb_to_lab": q(*LAB, select=f"SELECT image_id, y, x, round(116.0::DOUBLE * {_f('cy')} - 16.0::DOUBLE, 4) + 0.0::DOUBLE AS l, round(500.0::DOUBLE * ({_f('cx')} - {_f('cy')}), 4) + 0.0::DOUBLE AS a_star, round(200.0::DOUBLE * ({_f('cy')} - {_f('cz')}), 4) + 0.0::DOUBLE AS b_star FROM xy"),
    "stride_sample": q(select="SELECT image_id, y, x, r FROM px WHERE y % 4 = 0 AND x % 4 = 0"),
    "color_histogram": q(select=f"SELECT image_id, {PACKED} AS packed, count(*) AS n FROM px GROUP BY ALL"),
    "local_median": q(block("CAST(o.r AS DOUBLE)"), select="SELECT image_id, y, x, list_sort(v)[5] AS median, list_max(v) - list_min(v) AS spread FROM bl"),
    "denoise": q(block("o.r", "br"), block("o.g", "bg"), block("o.b", "bb"), select="SELECT br.image_id, br.y, br.x, list_sort(br.v)[5] AS r, list_sort(bg.v)[5] AS g, list_sort(bb.v)[5] AS b, br.a FROM br JOIN bg ON (br.image_id, br.y, br.x) = (bg.image_id, bg.y, bg.x) JOIN bb ON (br.image_id, br.y, br.x) = (bb.image_id, bb.y, bb.x)"),
    "analyze_content": q(
        block("o.r * 0.299::DOUBLE + o.g * 0.587::DOUBLE + o.b * 0.114::DOUBLE"),
        f"ag AS (SELECT image_id, count(*) FILTER (a > 127.5) AS samples, avg(abs({LUMA} - list_sort(v)[5])) FILTER (a > 127.5) AS t, avg(CAST(list_max(v) - list_min(v) > 6 AS DOUBLE)) FILTER (a > 127.5) AS s, avg(CAST(list_max(v) - list_min(v) < 6 AS DOUBLE)) FILTER (a > 127.5) AS f, count(DISTINCT CASE WHEN a > 127.5 THEN {PACKED} END) AS unique_colors, avg(CAST(a < 0.99 * 255 AS DOUBLE)) AS transparency FROM bl GROUP BY image_id)",
        select="""SELECT image_id, samples, round(CASE WHEN samples >= 32 THEN t ELSE 0 END, 6) AS texture, round(CASE WHEN samples >= 32 THEN s ELSE 0 END, 6) AS spread, round(CASE WHEN samples >= 32 THEN f ELSE 1 END, 6) AS flatness, unique_colors, round(transparency, 6) AS transparency,
  CASE WHEN samples < 32 THEN 'illustration' WHEN t >= 1.6 AND s >= 0.35 THEN 'photo' WHEN f > 0.6 AND unique_colors < 900 THEN 'icon' ELSE 'illustration' END AS kind,
  round(CASE WHEN samples < 32 THEN 0 WHEN t >= 1.6 AND s >= 0.35 THEN least(1, t / 3.2::DOUBLE) WHEN f > 0.6 AND unique_colors < 900 THEN least(1, f) ELSE 0.5 + least(0.45, abs(t - 1.6) / 3.2) END, 6) AS confidence FROM ag""",
    ),
    "window_max": q(select="SELECT p.image_id, p.y, p.x, max(o.a) AS most FROM px p JOIN px o ON o.image_id = p.image_id AND o.y BETWEEN p.y - 2 AND p.y + 2 AND o.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY ALL"),
    "sobel_edges": q(block("CAST(o.r + o.g + o.b AS DOUBLE) / 3.0::DOUBLE"), select=f"SELECT image_id, y, x, round({SOBEL}, 6) AS edge FROM bl"),
    "edge_correlation": q(block("CAST(o.r AS DOUBLE)", "br"), block("CAST(o.g AS DOUBLE)", "bg"), f"er AS (SELECT image_id, y, x, {SOBEL} AS e FROM br)", f"eg AS (SELECT image_id, y, x, {SOBEL} AS e FROM bg)", select="SELECT er.image_id, round(corr(er.e, eg.e), 6) AS edges FROM er JOIN eg USING (image_id, y, x) GROUP BY er.image_id"),
    "border_statistics": q(BORDER, select="SELECT image_id, mr, mg, mb, round(avg((abs(r - mr) + abs(g - mg) + abs(b - mb)) / 3.0::DOUBLE), 6) AS deviation FROM ed JOIN mid USING (image_id) GROUP BY ALL"),
    "backdrop_candidates": q(BORDER, select="SELECT image_id, y, x FROM px JOIN mid USING (image_id) WHERE greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 100 AND a > 0"),
    "boundary_mask": q(LABELS, select=f"SELECT p.image_id, p.y, p.x, bool_or(o.label IS NOT NULL AND o.label <> p.label) AS on_boundary FROM (SELECT * FROM lb, {SHIFTS}) p LEFT JOIN lb o ON o.image_id = p.image_id AND o.y = p.y + dy AND o.x = p.x + dx GROUP BY ALL"),
    "dilate_mask": q(select="SELECT p.image_id, p.y, p.x FROM px p WHERE a > 100 AND EXISTS (SELECT 1 FROM px o WHERE o.image_id = p.image_id AND o.r > 150 AND abs(o.y - p.y) + abs(o.x - p.x) <= 2)"),
    "distance_to_outside": q(select="SELECT p.image_id, p.y, p.x, round(min(sqrt(CAST((o.y - p.y) ** 2 + (o.x - p.x) ** 2 AS DOUBLE))), 6) AS distance FROM px p LEFT JOIN px o ON o.image_id = p.image_id AND o.a < 100 AND (o.y - p.y) ** 2 + (o.x - p.x) ** 2 <= 9 GROUP BY ALL"),
    "components": q(LABELS, *flood("lb"), recursive=True, select="SELECT image_id, y, x, label, component FROM cp"),
    "component_summary": q(LABELS, *flood("lb"), summary("cp", "component"), recursive=True, select="SELECT * FROM st"),
    "component_sizes": q(LABELS, *flood("lb"), summary("cp", "component"), recursive=True, select="SELECT image_id, area, count(*) AS n FROM st GROUP BY ALL"),
    "label_adjacency": q(LABELS, ADJACENT, select="SELECT * FROM ad"),
    "adjacency_map": q(LABELS, ADJACENT, SYMMETRIC, select="SELECT l.image_id, l.label, COALESCE(string_agg(CAST(other AS VARCHAR), ',' ORDER BY other), '') AS neighbours FROM (SELECT DISTINCT image_id, label FROM lb) l LEFT JOIN sy ON sy.image_id = l.image_id AND node = l.label GROUP BY ALL"),
    "region_contrast": q(LABELS, ADJACENT, SYMMETRIC, summary("lb", "label"), CONTRAST, select="SELECT * FROM co"),
    "cheapest_regions": q(LABELS, ADJACENT, SYMMETRIC, summary("lb", "label"), CONTRAST, select="SELECT image_id, label, speck FROM (SELECT *, row_number() OVER (PARTITION BY image_id, speck ORDER BY worth ASC NULLS LAST, label) AS k, count(*) FILTER (NOT speck) OVER (PARTITION BY image_id) AS rest FROM (SELECT *, area < 20 AS speck FROM co)) WHERE speck OR k <= rest - 2"),
    "nearest_center": q("ce AS (SELECT CAST(i AS INT) AS k, i * 36 AS cr, 255 - i * 30 AS cg, i * 77 % 256 AS cb FROM range(8) t(i))", select="SELECT image_id, y, x, arg_min(k, row((r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2, k)) AS label FROM px, ce GROUP BY ALL"),
    "perceptual_distance": q(select="SELECT image_id, y, x, round(sqrt(((2.0::DOUBLE + (r + g) / 2.0::DOUBLE / 256.0::DOUBLE) * (r - g) * (r - g) + 4.0::DOUBLE * (g - b) * (g - b) + (2.0::DOUBLE + (255.0::DOUBLE - (r + g) / 2.0::DOUBLE) / 256.0::DOUBLE) * (b - r) * (b - r)) / 3.0::DOUBLE), 6) AS distance FROM px"),
    "resolve_redirects": """WITH RECURSIVE ch AS (SELECT i % 7 AS image_id, i AS label, i - 7 * (1 + i % 3) AS target FROM range(1, 1000) t(i) WHERE i - 7 * (1 + i % 3) >= 0),
fo AS (SELECT image_id, label, target FROM ch UNION ALL SELECT fo.image_id, fo.label, ch.target FROM fo JOIN ch ON ch.image_id = fo.image_id AND ch.label = fo.target)
SELECT image_id, label, min(target) AS target FROM fo GROUP BY ALL""",
    "clear_backdrop": q("lb AS (SELECT *, CASE WHEN r < 128 THEN 1 ELSE 0 END AS label FROM px)", *flood("lb"), "hw AS (SELECT image_id, max(y) AS h, max(x) AS w FROM px GROUP BY image_id)", "tc AS (SELECT DISTINCT image_id, component FROM cp JOIN hw USING (image_id) WHERE component > 0 AND (y = 0 OR x = 0 OR y = h OR x = w))", recursive=True, select="SELECT cp.image_id, y, x, CASE WHEN tc.component IS NOT NULL THEN 0 ELSE a END AS a FROM cp LEFT JOIN tc ON tc.image_id = cp.image_id AND tc.component = cp.component"),
    "flat_paint": q(LABELS, "mn AS (SELECT image_id, label, avg(CAST(r AS DOUBLE)) AS mr, avg(CAST(g AS DOUBLE)) AS mg, avg(CAST(b AS DOUBLE)) AS mb FROM lb GROUP BY ALL)", select="SELECT image_id, label, round(any_value(mr), 6) AS r, round(any_value(mg), 6) AS g, round(any_value(mb), 6) AS b, round(avg(sqrt((r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2)), 6) AS residual FROM lb JOIN mn USING (image_id, label) GROUP BY image_id, label"),
    "plane_slopes": q(LABELS, "sm AS (SELECT image_id, label, avg(CAST(g AS DOUBLE)) AS mc, covar_pop(x::DOUBLE, x::DOUBLE) AS xx, covar_pop(y::DOUBLE, y::DOUBLE) AS yy, covar_pop(x::DOUBLE, y::DOUBLE) AS xy, covar_pop(x::DOUBLE, g::DOUBLE) AS xc, covar_pop(y::DOUBLE, g::DOUBLE) AS yc FROM lb GROUP BY ALL)", select="SELECT image_id, label, round(mc, 6) AS mean, CASE WHEN xx * yy - xy * xy > 1e-9 THEN round((xc * yy - yc * xy) / (xx * yy - xy * xy), 6) END AS gx, CASE WHEN xx * yy - xy * xy > 1e-9 THEN round((yc * xx - xc * xy) / (xx * yy - xy * xy), 6) END AS gy FROM sm"),
    "gradient_stops": q(LABELS, "eg AS (SELECT image_id, label, quantile_cont(x::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lb GROUP BY ALL)", "bn AS (SELECT lb.image_id, lb.label, lb.x, lb.b, least(4, len(list_filter(e, lambda v: v <= lb.x)) - 1) AS stop FROM lb JOIN eg USING (image_id, label))", select="SELECT image_id, label, CAST(stop AS INT) AS stop, count(*) AS n, round(avg(x::DOUBLE), 6) AS \"offset\", round(avg(b::DOUBLE), 6) AS value FROM bn GROUP BY image_id, label, stop HAVING count(*) >= 2"),
    "stop_interpolation": q("tt AS (SELECT *, r / 255.0::DOUBLE AS t FROM px)", select="SELECT image_id, y, x, round(CASE WHEN t < 0.1::DOUBLE THEN 10 WHEN t < 0.4::DOUBLE THEN 10.0::DOUBLE + 190.0::DOUBLE * (t - 0.1::DOUBLE) / (0.4::DOUBLE - 0.1::DOUBLE) WHEN t < 0.8::DOUBLE THEN 200.0::DOUBLE + -150.0::DOUBLE * (t - 0.4::DOUBLE) / (0.8::DOUBLE - 0.4::DOUBLE) ELSE 50 END, 6) AS value, round(least(1, greatest(0, ((x - 5.0::DOUBLE) * 55.0::DOUBLE + (y - 5.0::DOUBLE) * 35.0::DOUBLE) / 4250.0::DOUBLE)), 6) AS along, round(least(1, sqrt((x - 32.0::DOUBLE) ** 2 + (y - 25.0::DOUBLE) ** 2) / 30.0::DOUBLE), 6) AS \"out\" FROM tt"),
    "polygon_area": q(RINGS, around("rg", 1, "a1"), select="SELECT image_id, ring, round(abs(sum(x * fy - y * fx)) / 2.0::DOUBLE, 6) AS area FROM a1 GROUP BY ALL"),
    "smooth_polyline": q(RINGS, around("rg", 1, "a1"), eased("a1", "s1"), around("s1", 1, "a2"), eased("a2", "s2"), select="SELECT * FROM s2"),
    "turn_angles": q(RINGS, around("rg", 2, "a1"), "uv AS (SELECT image_id, ring, seq, x - bx AS ux, y - cy AS uy, fx - x AS vx, fy - y AS vy FROM a1)", select="SELECT image_id, ring, seq, round(COALESCE(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / nullif(sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy), 0))))), 0), 6) AS turn FROM uv"),
    "chord_parameters": q(RINGS, "st AS (SELECT *, COALESCE(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM rg WINDOW w AS (PARTITION BY image_id, ring ORDER BY seq))", select="SELECT image_id, ring, seq, round(COALESCE(sum(s) OVER (PARTITION BY image_id, ring ORDER BY seq ROWS UNBOUNDED PRECEDING) / nullif(sum(s) OVER (PARTITION BY image_id, ring), 0), seq / 63.0::DOUBLE), 6) AS t FROM st"),
    "drop_repeats": q(RINGS, "co AS (SELECT image_id, ring, seq, floor(x / 100.0::DOUBLE) AS x, floor(y / 100.0::DOUBLE) AS y FROM rg)", select="SELECT * FROM co WINDOW w AS (PARTITION BY image_id, ring ORDER BY seq) QUALIFY NOT COALESCE(x = lag(x) OVER w AND y = lag(y) OVER w, false)"),
    "bezier_points": q("tt AS (SELECT *, x / 64.0::DOUBLE AS t, 1.0::DOUBLE - x / 64.0::DOUBLE AS u FROM px)", select="SELECT image_id, y, x, round(u * u * u * r + 3.0::DOUBLE * u * u * t * g + 3.0::DOUBLE * u * t * t * b + t * t * t * a, 6) AS point FROM tt"),
    "hex_colors": q(select="SELECT image_id, y, x, printf('#%02X%02X%02X', r, g, b) AS color FROM px"),
    "path_numbers": q("fx AS (SELECT image_id, y, x, printf('%.1f', round_even((r - g) / 8.0::DOUBLE, 1)) AS p, printf('%.2f', round_even((r - g) / 8.0::DOUBLE, 2)) AS t FROM px)", f"sh AS (SELECT image_id, y, x, regexp_replace({_TRIM.format('p')}, '^(-?)0\\.', '\\1.') AS p, {_TRIM.format('t')} AS t FROM fx)", select="SELECT image_id, y, x, CASE WHEN p IN ('-0', '', '-') THEN '0' ELSE p END AS path, CASE WHEN t = '-0' THEN '0' ELSE t END AS attribute FROM sh"),
    "node_count": q(select="SELECT image_id, y, x, CAST(3 + CASE WHEN g > 100 THEN 1 ELSE 0 END AS INT) AS nodes FROM px"),
    "paint_order": q(LABELS, select="SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) AS INT) AS z FROM lb GROUP BY image_id, label"),
    "latest_job_state": "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "stale_jobs": "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE (user_id, strftime(ts, '%Y-%m-%d')) NOT IN (SELECT (user_id, strftime(ts, '%Y-%m-%d')) FROM events WHERE event_type = 'purchase')",
    "baseline_compare": q(LABELS, summary("lb", "label"), "sc AS (SELECT CAST(image_id AS VARCHAR) AS name, round(avg(mean_r) / 255.0::DOUBLE, 6) AS score FROM st GROUP BY image_id)", "ws AS (SELECT CAST(i AS VARCHAR) AS name, 0.49::DOUBLE AS was FROM range(12) t(i))", select="SELECT name, was, score, CASE WHEN score IS NULL THEN 'missing' ELSE 'lower' END AS complaint FROM ws LEFT JOIN sc USING (name) WHERE score IS NULL OR score < was - 0.01::DOUBLE"),
    "resize_lanczos": resized(32, 25, "lanczos"),
    "supersample_bilinear": resized(128, 100, "bilinear"),
    "supersample_bicubic": resized(128, 100, "bicubic"),
    "structural_similarity": ssim(),
    "settings_table": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([f"'{p}'", f"'{t}'", *(_literal(settings(p, t)[n]) for n in _SETTINGS)]) + ")" for p in sorted(PRESETS) for t in sorted(TIERS)) + f") s(preset, quality, {', '.join(_SETTINGS)})",
}
