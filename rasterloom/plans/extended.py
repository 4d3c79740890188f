"""More registered queries of the raster engine, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analysis, batch, geometry, neighbourhood, paint, pixels, regions, text
from ..operators.pixels import d
from ..sources.rasters import DRAWINGS, DRAWN, SUFFIXES, drawn, from_embeddings
from .oracle import ADJACENT, BORDER, CONTRAST, LABELS, RINGS, SHIFTS, SYMMETRIC, _f, _linear, around, flood, q, summary

#: name: (query, SQL)
EXTENDED: dict[str, tuple] = {}
KEY = ["image_id", "label"]
RING = ["image_id", "ring"]


def query(sql: str):
    def add(f):
        EXTENDED[f.__name__] = (f, sql)
        return f

    return add


def raster(spark, sf_dir):
    return from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def labels(spark, sf_dir):
    return raster(spark, sf_dir).withColumn("label", F.expr("cast(r div 32 as int) + 1"))


def rings(spark, sf_dir):
    return raster(spark, sf_dir).select("image_id", F.col("y").alias("ring"), F.col("x").alias("seq"), F.col("r").cast("double").alias("x_"), F.col("g").cast("double").alias("y_")).toDF("image_id", "ring", "seq", "x", "y")


@query(q(select="SELECT image_id, y, x FROM px JOIN (SELECT image_id, max(a) AS m FROM px GROUP BY image_id) USING (image_id) WHERE CASE WHEN m >= 128 THEN a >= 128 ELSE a > 0 END"))
def silhouette(spark, sf_dir):
    return analysis.silhouette(raster(spark, sf_dir)).select("image_id", "y", "x")


@query(q(select="SELECT image_id, round(avg(CAST(a < 229.5 AS DOUBLE)), 6) AS share, avg(CAST(a < 229.5 AS DOUBLE)) > 0.06 AS translucent FROM px GROUP BY image_id"))
def translucency(spark, sf_dir):
    return analysis.translucency(raster(spark, sf_dir))


LAB = (
    f"li AS (SELECT image_id, y, x, a, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM px)",
    "xy AS (SELECT image_id, y, x, a, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.95047::DOUBLE AS cx, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS cy, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.08883::DOUBLE AS cz FROM li)",
    "tr AS (SELECT image_id, avg(CAST(a < 229.5 AS DOUBLE)) > 0.06 AS translucent FROM px GROUP BY image_id)",
)


@query(q(*LAB, select=f"SELECT image_id, y, x, round(116.0::DOUBLE * {_f('cy')} - 16.0::DOUBLE, 4) + 0.0::DOUBLE AS f1, round(500.0::DOUBLE * ({_f('cx')} - {_f('cy')}), 4) + 0.0::DOUBLE AS f2, round(200.0::DOUBLE * ({_f('cy')} - {_f('cz')}), 4) + 0.0::DOUBLE AS f3, CASE WHEN translucent THEN round(a / 255.0::DOUBLE * 45.0::DOUBLE, 4) END AS f4 FROM xy JOIN tr USING (image_id)"))
def feature_vectors(spark, sf_dir):
    return analysis.features(raster(spark, sf_dir)).select("image_id", "y", "x", *((F.round(f"f{k}", 4) + d(0)).alias(f"f{k}") for k in (1, 2, 3)), F.round("f4", 4).alias("f4"))


@query(
    q(
        BORDER,
        "dv AS (SELECT image_id, avg((abs(r - mr) + abs(g - mg) + abs(b - mb)) / 3.0::DOUBLE) AS deviation FROM ed JOIN mid USING (image_id) GROUP BY image_id)",
        "cd AS (SELECT px.*, CASE WHEN greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 100 AND a > 0 THEN 1 ELSE 0 END AS label FROM px JOIN mid USING (image_id))",
        *flood("cd", "cc"),
        "tc AS (SELECT DISTINCT image_id, component FROM cc JOIN sz USING (image_id) WHERE component > 0 AND (y = 0 OR x = 0 OR y = h OR x = w))",
        "fl AS (SELECT cc.image_id, cc.y, cc.x, CASE WHEN tc.component IS NULL THEN 1 ELSE 0 END AS label FROM cc LEFT JOIN tc ON tc.image_id = cc.image_id AND tc.component = cc.component)",
        *(c.replace("nb AS", "nb2 AS").replace("re AS", "re2 AS").replace("JOIN nb ON nb.", "JOIN nb2 ON nb2.").replace("FROM re JOIN", "FROM re2 JOIN").replace("= re.image_id", "= re2.image_id").replace("SELECT re.image_id", "SELECT re2.image_id").replace("FROM re GROUP", "FROM re2 GROUP") for c in flood("fl", "fc")),
        "ou AS (SELECT image_id, component, bool_or(y = 0 OR x = 0 OR y = h OR x = w) AS o FROM fc JOIN sz USING (image_id) WHERE component > 0 GROUP BY ALL)",
        "il AS (SELECT image_id, count(*) FILTER (NOT o) AS islands FROM ou GROUP BY image_id)",
        "sh AS (SELECT image_id, avg(1.0::DOUBLE - label) AS share FROM fl GROUP BY image_id)",
        recursive=True,
        select="SELECT dv.image_id, round(deviation, 6) AS deviation, round(share, 6) AS share, COALESCE(islands, 0) AS islands, deviation <= 80 AND share BETWEEN 0.02 AND 0.97 AND COALESCE(islands, 0) <= 32 AS goes FROM dv JOIN sh USING (image_id) LEFT JOIN il USING (image_id)",
    )
)
def backdrop_guards(spark, sf_dir):
    return analysis.backdrop_verdict(raster(spark, sf_dir), 100.0, 80.0)


@query(q("cl AS (SELECT image_id, r // 64 AS k, count(*) AS n, avg(r::DOUBLE) AS t, 1 - avg(g::DOUBLE) / 255 AS f FROM px GROUP BY ALL)", select="SELECT image_id, CAST(k AS INT) AS k, 'icon: texture ' || printf('%.2f', round(t, 2)) || ', ' || printf('%.0f', round(f * 100)) || ' % flat' AS line FROM cl"))
def summary_lines(spark, sf_dir):
    figures = raster(spark, sf_dir).groupBy("image_id", F.expr("cast(r div 64 as int)").alias("k")).agg(F.round(F.avg(F.col("r").cast("double")), 2).alias("texture"), (F.round((d(1) - F.avg(F.col("g").cast("double")) / d(255)) * d(100)) / d(100)).alias("flatness"))
    return figures.withColumn("kind", F.lit("icon")).select("image_id", "k", analysis.summary_line().alias("line"))


DONOR = """dn AS (SELECT p.image_id, p.y, p.x, arg_min(o.r * 65536 + o.g * 256 + o.b, ((o.y - p.y) ** 2 + (o.x - p.x) ** 2) * 1000000 + o.y * 1000 + o.x) AS given
  FROM {of} p JOIN {of} o ON o.image_id = p.image_id AND {gives} AND (o.y - p.y) ** 2 + (o.x - p.x) ** 2 <= {far} WHERE {takes} GROUP BY ALL)"""
GIVEN = "SELECT p.image_id, p.y, p.x, CAST(CASE WHEN given IS NULL THEN r ELSE given // 65536 END AS INT) AS r, CAST(CASE WHEN given IS NULL THEN g ELSE given // 256 % 256 END AS INT) AS g, CAST(CASE WHEN given IS NULL THEN b ELSE given % 256 END AS INT) AS b, a FROM {of} p LEFT JOIN dn ON dn.image_id = p.image_id AND dn.y = p.y AND dn.x = p.x"


@query(q(DONOR.format(of="px", gives="o.a >= 128", far=16, takes="p.a < 128"), select=GIVEN.format(of="px")))
def nearest_donor(spark, sf_dir):
    return neighbourhood.nearest_donor(raster(spark, sf_dir), "a < 128", "a >= 128", 4)


def soft(spark, sf_dir):
    """The rasters with three levels of alpha, some of them outside."""
    return raster(spark, sf_dir).withColumn("a", F.when(F.col("r") < 60, 0).when(F.col("r") < 110, 120).otherwise(255))


SOFT = "sf AS (SELECT image_id, y, x, r, g, b, CASE WHEN r < 60 THEN 0 WHEN r < 110 THEN 120 ELSE 255 END AS a FROM px)"
FAR = "fa AS (SELECT p.*, (SELECT min(sqrt(CAST((o.y - p.y) ** 2 + (o.x - p.x) ** 2 AS DOUBLE))) FROM sf o WHERE o.image_id = p.image_id AND o.a < 5.1 AND (o.y - p.y) ** 2 + (o.x - p.x) ** 2 <= 4) AS distance FROM sf p)"


@query(q(SOFT, FAR, "kp AS (SELECT *, a >= 229.5 OR a >= 5.1 AND distance IS NULL AS kept FROM fa)", DONOR.format(of="kp", gives="o.kept", far=25, takes="NOT p.kept"), select=GIVEN.format(of="kp")))
def color_repair(spark, sf_dir):
    return neighbourhood.repair_colors(soft(spark, sf_dir), 2)


@query(q(SOFT, FAR, "wm AS (SELECT p.image_id, p.y, p.x, max(o.a) AS most FROM sf p JOIN sf o ON o.image_id = p.image_id AND o.y BETWEEN p.y - 2 AND p.y + 2 AND o.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY ALL)", select="SELECT image_id, y, x, round(CASE WHEN a / 255.0::DOUBLE >= 0.25 AND most < 229.5 THEN a / 255.0::DOUBLE + (1.0::DOUBLE - a / 255.0::DOUBLE) * least(1, COALESCE(distance, 2.0::DOUBLE) / 2.0::DOUBLE) ELSE a / 255.0::DOUBLE END, 6) AS coverage FROM fa JOIN wm USING (image_id, y, x)"))
def coverage_remap(spark, sf_dir):
    return neighbourhood.coverage(soft(spark, sf_dir), 2).select("image_id", "y", "x", F.round("coverage", 6).alias("coverage"))


@query(q("bd AS (SELECT * FROM px WHERE r > 90)", select="SELECT p.image_id, p.y, p.x, round(avg(o.g::DOUBLE), 6) AS average FROM bd p JOIN bd o ON o.image_id = p.image_id AND o.y BETWEEN p.y - 2 AND p.y + 2 AND o.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY ALL"))
def band_average(spark, sf_dir):
    return neighbourhood.band_average(raster(spark, sf_dir).filter("r > 90"), "g", 2).select("image_id", "y", "x", F.round("average", 6).alias("average"))


COARSE = "lb AS (SELECT *, r // 128 + 1 AS label FROM px)"


def coarse(spark, sf_dir):
    return raster(spark, sf_dir).withColumn("label", F.expr("cast(r div 128 as int) + 1"))


INTERIOR = f"""bo AS (SELECT DISTINCT p.image_id, p.y, p.x FROM lb p, {SHIFTS} JOIN lb o ON o.image_id = p.image_id AND o.y = p.y + dy AND o.x = p.x + dx WHERE o.label <> p.label),
ir AS (SELECT * FROM lb p WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.image_id = p.image_id AND abs(bo.y - p.y) + abs(bo.x - p.x) <= 1))"""


@query(q(COARSE, INTERIOR, select="SELECT image_id, y, x, label FROM ir"))
def interior_mask(spark, sf_dir):
    return neighbourhood.interior(coarse(spark, sf_dir), 1).select("image_id", "y", "x", "label")


@query(q(COARSE, INTERIOR, select="SELECT image_id, y, x, CASE WHEN (image_id, y, x) IN (SELECT (image_id, y, x) FROM ir) THEN label ELSE 0 END AS region FROM lb"))
def region_scatter(spark, sf_dir):
    whole = coarse(spark, sf_dir)
    return regions.scattered(whole, neighbourhood.interior(whole, 1).withColumn("region", F.col("label"))).select("image_id", "y", "x", "region")


@query(q(COARSE, INTERIOR, select='SELECT l.image_id, l.label, COALESCE(n, 0) AS "inner", COALESCE(n, 0) >= 4 AS solid FROM (SELECT DISTINCT image_id, label FROM lb) l LEFT JOIN (SELECT image_id, label, count(*) AS n FROM ir GROUP BY ALL) i ON i.image_id = l.image_id AND i.label = l.label'))
def solid_shapes(spark, sf_dir):
    return regions.solid(coarse(spark, sf_dir), 1, "label")


def _shapes(spark, sf_dir):
    return labels(spark, sf_dir).select("image_id", "label").distinct().withColumn("solid", F.col("label") <= 3)


CHAIN = ("lq AS (SELECT image_id, y, x, r // 32 + 1 AS part, CASE WHEN r // 32 + 1 <= 3 THEN 0 ELSE 1 END AS label FROM px)", *flood("lq", "ch"))


@query(q(*CHAIN, recursive=True, select=f"""SELECT c.image_id, CAST(c.component AS INT) AS chain, COALESCE(string_agg(DISTINCT CAST(o.part AS VARCHAR), ',' ORDER BY CAST(o.part AS VARCHAR)) FILTER (o.part <= 3), '') AS shapes,
  count(DISTINCT c.y * 64 + c.x) AS pixels, bool_or(o.part IS NULL) AS rim FROM (SELECT * FROM ch, {SHIFTS}) c LEFT JOIN lq o ON o.image_id = c.image_id AND o.y = c.y + dy AND o.x = c.x + dx WHERE component > 0 GROUP BY c.image_id, c.component"""))
def chain_shapes(spark, sf_dir):
    found = regions.chain_shapes(labels(spark, sf_dir), _shapes(spark, sf_dir))
    return found.select("image_id", "chain", F.array_join(F.col("shapes").cast("array<string>"), ",").alias("shapes"), "pixels", "rim")


STATS = (LABELS, ADJACENT, SYMMETRIC, summary("lb", "label"))


def _stats(spark, sf_dir):
    whole = labels(spark, sf_dir)
    return regions.summary(whole, "label"), regions.adjacency(whole, "label")


@query(q(*STATS, """rk AS (SELECT sy.image_id, node AS label, other, q.area < 300 AS leaves, round((p.mean_r - q.mean_r) ** 2 + (p.mean_g - q.mean_g) ** 2 + (p.mean_b - q.mean_b) ** 2, 3) AS far
  FROM sy JOIN st p ON p.image_id = sy.image_id AND p.label = node JOIN st q ON q.image_id = sy.image_id AND q.label = other WHERE p.area < 300)""", select="SELECT image_id, label, arg_min(other, row(leaves, far, other)) AS target FROM rk GROUP BY ALL"))
def absorption_targets(spark, sf_dir):
    stats, edges = _stats(spark, sf_dir)
    return regions.absorption_targets(stats, edges, stats.filter("area < 300").select("image_id", "label"), "label")


@query(q(LABELS, summary("lb", "label"), select="SELECT image_id, label, mean_r, mean_g, mean_b FROM st QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) = 1"))
def largest_region(spark, sf_dir):
    return regions.largest(_stats(spark, sf_dir)[0], "label")


@query(q("lb AS (SELECT *, x // 16 * 4 + y // 13 + 1 AS label FROM px WHERE r > 140)", summary("lb", "label"), select='SELECT a.image_id, CAST(a.label AS INT) AS lo, CAST(b.label AS INT) AS hi FROM st a JOIN st b ON a.image_id = b.image_id AND a.label < b.label WHERE a."left" < b."right" + 0.5 AND b."left" < a."right" + 0.5 AND a."top" < b.bottom + 0.5 AND b."top" < a.bottom + 0.5'))
def box_overlaps(spark, sf_dir):
    tiles = raster(spark, sf_dir).filter("r > 140").withColumn("label", F.expr("cast(x div 16 * 4 + y div 13 + 1 as int)"))
    return regions.overlapping(regions.summary(tiles, "label"), "label")


@query(q(LABELS, ADJACENT, SYMMETRIC, "ar AS (SELECT image_id, label, count(*) AS area FROM lb GROUP BY ALL)", select="""SELECT a.image_id, lo, hi, p.area + q.area AS area, COALESCE((SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FROM (SELECT DISTINCT other AS n FROM sy WHERE sy.image_id = a.image_id AND node IN (lo, hi) AND other NOT IN (lo, hi))), '') AS neighbours
  FROM ad a JOIN ar p ON p.image_id = a.image_id AND p.label = lo JOIN ar q ON q.image_id = a.image_id AND q.label = hi"""))
def region_unions(spark, sf_dir):
    whole = labels(spark, sf_dir)
    edges = regions.adjacency(whole, "label")
    area = whole.groupBy("image_id", "label").agg(F.count("*").alias("area")).join(regions.neighbours(whole, edges, "label"), KEY)
    return regions.united(area, edges, "label")


@query(q(LABELS, ADJACENT, SYMMETRIC, summary("lb", "label"), CONTRAST, "wo AS (SELECT image_id, label, worth, row_number() OVER (PARTITION BY image_id ORDER BY worth DESC NULLS FIRST, label) AS place FROM co)", select="SELECT image_id, label, worth FROM wo WHERE place <= 2"))
def two_most_worth(spark, sf_dir):
    """The two ends that most speak for: a ranking of parts within an image, ties by number."""
    stats, edges = _stats(spark, sf_dir)
    order = Window.partitionBy("image_id").orderBy(F.col("worth").desc_nulls_first(), "label")
    return regions.contrast(stats, edges, "label").withColumn("place", F.row_number().over(order)).filter("place <= 2").select("image_id", "label", "worth")


# paints


@query(q(LABELS, "sm AS (SELECT image_id, label, avg(r::DOUBLE) AS mr, avg(g::DOUBLE) AS mg, avg(b::DOUBLE) AS mb FROM lb GROUP BY ALL)", "ds AS (SELECT image_id, label, a, (r + mr) / 2.0::DOUBLE AS m, r - mr AS dr, g - mg AS dg, b - mb AS db FROM lb JOIN sm USING (image_id, label))", select="SELECT image_id, label, round(avg(sqrt(((2.0::DOUBLE + m / 256.0::DOUBLE) * dr * dr + 4.0::DOUBLE * dg * dg + (2.0::DOUBLE + (255.0::DOUBLE - m) / 256.0::DOUBLE) * db * db) / 3.0::DOUBLE)) + avg(abs(a / 255.0::DOUBLE - 1.0::DOUBLE)) * 90.0::DOUBLE, 6) AS residual FROM ds GROUP BY ALL"))
def paint_residual(spark, sf_dir):
    whole = labels(spark, sf_dir)
    mean = whole.groupBy(*KEY).agg(*(F.avg(F.col(c).cast("double")).alias(f"m{c}") for c in "rgb"))
    return paint.residual(whole.join(mean, KEY), KEY, tuple(F.col(f"m{c}") for c in "rgb"), d(1))


SLOPES = ", ".join(f"(covar_pop(x::DOUBLE, {c}::DOUBLE) * covar_pop(y::DOUBLE, y::DOUBLE) - covar_pop(y::DOUBLE, {c}::DOUBLE) * covar_pop(x::DOUBLE, y::DOUBLE)) AS n{c}x, (covar_pop(y::DOUBLE, {c}::DOUBLE) * covar_pop(x::DOUBLE, x::DOUBLE) - covar_pop(x::DOUBLE, {c}::DOUBLE) * covar_pop(x::DOUBLE, y::DOUBLE)) AS n{c}y" for c in "rgb")
RISE = (
    LABELS,
    f"sl AS (SELECT image_id, label, covar_pop(x::DOUBLE, x::DOUBLE) * covar_pop(y::DOUBLE, y::DOUBLE) - covar_pop(x::DOUBLE, y::DOUBLE) ** 2 AS det, {SLOPES} FROM lb GROUP BY ALL)",
    "sr AS (SELECT image_id, label, " + ", ".join(f"round(n{c}{k} / det, 6) AS s{c}{k}" for c in "rgb" for k in "xy") + " FROM sl WHERE det > 1e-9)",
    "xx AS (SELECT image_id, label, srx * srx + sgx * sgx + sbx * sbx AS xx, sry * sry + sgy * sgy + sby * sby AS yy, srx * sry + sgx * sgy + sbx * sby AS xy FROM sr)",
    "hf AS (SELECT *, sqrt((xx - yy) * (xx - yy) / 4.0::DOUBLE + xy * xy) AS half FROM xx)",
)


@query(q(*RISE, select="SELECT image_id, label, round((xx + yy) / 2.0::DOUBLE + half, 4) AS rise, round((1.0::DOUBLE + COALESCE((xx - yy) / 2.0::DOUBLE / nullif(half, 0), 0)) / 2.0::DOUBLE, 4) AS x_share FROM hf"))
def paint_fit_linear(spark, sf_dir):
    return paint.directions(labels(spark, sf_dir), KEY)


_COV = ", ".join(f"covar_pop({u}, {v}) AS {a}{b}" for a, u in (("x", "x::DOUBLE"), ("y", "y::DOUBLE"), ("z", "z::DOUBLE")) for b, v in (("x", "x::DOUBLE"), ("y", "y::DOUBLE"), ("z", "z::DOUBLE"), *((c, f"{c}::DOUBLE") for c in "rgb")))
CENTRES = (
    LABELS,
    f"cv AS (SELECT image_id, label, {_COV} FROM (SELECT *, x * x + y * y AS z FROM lb) GROUP BY ALL)",
    "pl AS (SELECT *, xx * yy - xy * xy AS det, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS px_, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS py_ FROM cv WHERE xx * yy - xy * xy > 1e-9)",
    "bn AS (SELECT *, zz - px_ * xz - py_ * yz AS rest, " + ", ".join(f"(z{c} - px_ * x{c} - py_ * y{c}) / (zz - px_ * xz - py_ * yz) AS d{c}" for c in "rgb") + " FROM pl WHERE zz - px_ * xz - py_ * yz > 1e-6)",
    "ln AS (SELECT image_id, label, dr * dr + dg * dg + db * db AS w, " + " + ".join(f"((x{c} * yy - y{c} * xy) / det - d{c} * px_) * d{c}" for c in "rgb") + " AS sx, " + " + ".join(f"((y{c} * xx - x{c} * xy) / det - d{c} * py_) * d{c}" for c in "rgb") + " AS sy FROM bn)",
)


@query(q(*CENTRES, select="SELECT image_id, label, round(-sx / (2.0::DOUBLE * w), 3) + 0.0::DOUBLE AS cx, round(-sy / (2.0::DOUBLE * w), 3) + 0.0::DOUBLE AS cy FROM ln WHERE w > 1e-9"))
def paint_fit_radial(spark, sf_dir):
    return paint.centres(labels(spark, sf_dir), KEY)


@query(q(LABELS, select="SELECT image_id, label, max(a) / 255.0::DOUBLE - min(a) / 255.0::DOUBLE >= 0.02 AS with_alpha, CASE WHEN max(a) / 255.0::DOUBLE - min(a) / 255.0::DOUBLE >= 0.02 THEN round(avg(a::DOUBLE), 6) END AS signal FROM lb GROUP BY ALL"))
def paint_signal(spark, sf_dir):
    return paint.signal_channels(labels(spark, sf_dir), KEY)


@query(q(select="SELECT image_id, y, x, round(least(255, greatest(0, CASE WHEN r = g THEN b ELSE b + (b - a) * (300.0::DOUBLE - r) / (r - g) END)), 6) AS value FROM px"))
def stop_extrapolation(spark, sf_dir):
    c = {n: F.col(n).cast("double") for n in "rgba"}
    return raster(spark, sf_dir).select("image_id", "y", "x", F.round(paint.extrapolated(c["r"], c["b"], c["g"], c["a"], d(300)), 6).alias("value"))


@query(q(LABELS, select="SELECT image_id, label, round(avg(abs(a / 255.0::DOUBLE - r / 255.0::DOUBLE)) * 90.0::DOUBLE, 6) AS error FROM lb GROUP BY ALL"))
def alpha_error(spark, sf_dir):
    return labels(spark, sf_dir).groupBy(*KEY).agg(F.round(paint.alpha_error(F.col("a") / d(255), F.col("r") / d(255), 90.0), 6).alias("error"))


@query(q(LABELS, summary("lb", "label"), select='SELECT image_id, label, sqrt((mean_r - ("left" + "right") / 2.0::DOUBLE) ** 2 + (mean_g - ("top" + bottom) / 2.0::DOUBLE) ** 2) <= 2.5::DOUBLE * sqrt(("right" - "left") ** 2 + (bottom - "top") ** 2) AND mean_b - 128 > 1e-6 AS valid FROM st'))
def radial_validity(spark, sf_dir):
    stats = _stats(spark, sf_dir)[0]
    box = tuple(F.col(c).cast("double") for c in ("left", "top", "right", "bottom"))
    return stats.select("image_id", "label", paint.radial_valid(F.col("mean_r"), F.col("mean_g"), F.col("mean_b") - d(128), box).alias("valid"))


_NUM = "regexp_replace(regexp_replace(printf('%.{1}f', round_even({0}, {1})), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def _num(v: str, p: int = 2) -> str:
    return _NUM.format(v, p)


KIND = "CASE WHEN r % 3 = 0 THEN 'flat' WHEN r % 3 = 1 THEN 'linear' ELSE 'radial' END"
GRADIENT = f"""'<' || k || 'Gradient id="g' || x || '" gradientUnits="userSpaceOnUse" ' || CASE WHEN k = 'linear' THEN 'x1' ELSE 'cx' END || '="' || {_num('x / 4.0::DOUBLE')} || '" ' || CASE WHEN k = 'linear' THEN 'y1' ELSE 'cy' END || '="' || {_num('y / 8.0::DOUBLE')} || '" '
  || CASE WHEN k = 'linear' THEN 'x2' ELSE 'r' END || '="' || {_num('r / 2.0::DOUBLE')} || '"' || CASE WHEN k = 'linear' THEN ' y2="' || {_num('g / 16.0::DOUBLE')} || '"' ELSE '' END || '><stop offset="0" stop-color="' || c || '"/><stop offset="' || {_num('g / 256.0::DOUBLE', 3)} || '" stop-color="#FFFFFF"'
  || CASE WHEN a / 256.0::DOUBLE < 0.995 THEN ' stop-opacity="' || {_num('a / 256.0::DOUBLE', 3)} || '"' ELSE '' END || '/></' || k || 'Gradient>'"""


def _paints(spark, sf_dir):
    kind = F.when(F.col("r") % 3 == 0, "flat").when(F.col("r") % 3 == 1, "linear").otherwise("radial")
    return raster(spark, sf_dir).select("*", kind.alias("kind"), F.concat(F.lit("g"), F.col("x").cast("string")).alias("name"), text.hex_color(*(F.col(c) for c in "rgb")).alias("color"), (F.col("a") / d(256)).alias("alpha"))


@query(q(f"kd AS (SELECT *, {KIND} AS k, printf('#%02X%02X%02X', r, g, b) AS c FROM px)", select=f"SELECT image_id, y, x, CASE WHEN k = 'flat' THEN NULL ELSE {GRADIENT} END AS element FROM kd"))
def gradient_definition(spark, sf_dir):
    stops = F.array(F.struct(d(0).alias("offset"), F.col("color"), d(1).alias("alpha")), F.struct((F.col("g") / d(256)).alias("offset"), F.lit("#FFFFFF").alias("color"), F.col("alpha").alias("alpha")))
    shape = [F.col("x") / d(4), F.col("y") / d(8), F.col("r") / d(2), F.col("g") / d(16)]
    return _paints(spark, sf_dir).select("image_id", "y", "x", paint.gradient_element(F.col("kind"), F.col("name"), shape, stops).alias("element"))


@query(q(f"kd AS (SELECT *, {KIND} AS k, printf('#%02X%02X%02X', r, g, b) AS c FROM px)", select=f"SELECT image_id, y, x, CASE WHEN k = 'flat' THEN 'fill=\"' || c || '\"' || CASE WHEN a / 256.0::DOUBLE < 0.995 THEN ' fill-opacity=\"' || {_num('a / 256.0::DOUBLE', 3)} || '\"' ELSE '' END ELSE 'fill=\"url(#g' || x || ')\"' END AS attributes FROM kd"))
def paint_attributes(spark, sf_dir):
    c = {n: F.col(n) for n in ("kind", "name", "color", "alpha")}
    return _paints(spark, sf_dir).select("image_id", "y", "x", paint.paint_attributes(c["kind"], c["name"], c["color"], c["alpha"]).alias("attributes"))


@query(q(select="SELECT image_id, count(*) FILTER (r % 3 <> 0) AS gradients FROM px GROUP BY image_id"))
def gradient_count(spark, sf_dir):
    return batch.ramp_count(_paints(spark, sf_dir), ["image_id"])


# contours and curves


@query(q(RINGS, around("rg", 1, "a1"), select="SELECT image_id, ring, count(*) AS points, round(abs(sum(x * fy - y * fx)) / 2.0::DOUBLE, 6) AS area FROM a1 GROUP BY ALL HAVING count(*) >= 8 AND round(abs(sum(x * fy - y * fx)) / 2.0::DOUBLE, 6) >= 20000"))
def kept_contours(spark, sf_dir):
    return geometry.kept_contours(rings(spark, sf_dir), RING, 8, 20_000.0)


@query(q(RINGS, "fs AS (SELECT r.image_id, r.ring, sum((r.x - f.x) / r.seq) AS dx, sum((r.y - f.y) / r.seq) AS dy FROM rg r JOIN rg f ON f.image_id = r.image_id AND f.ring = r.ring AND f.seq = 0 WHERE r.seq BETWEEN 1 AND 4 GROUP BY ALL)", select="SELECT image_id, ring, round(CASE WHEN sqrt(dx * dx + dy * dy) > 1e-12 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0 END, 6) + 0.0::DOUBLE AS tx, round(CASE WHEN sqrt(dx * dx + dy * dy) > 1e-12 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0 END, 6) + 0.0::DOUBLE AS ty FROM fs"))
def end_tangents(spark, sf_dir):
    return geometry.end_tangent(rings(spark, sf_dir), RING)


T = "ts AS (SELECT *, seq / 64.0::DOUBLE AS t, 1.0::DOUBLE - seq / 64.0::DOUBLE AS u FROM rg), bs AS (SELECT *, 3.0::DOUBLE * u * u * t AS b1, 3.0::DOUBLE * u * t * t AS b2 FROM ts)"


@query(q(RINGS, T, select="SELECT image_id, ring, round(sum(b1 * b1), 6) AS c11, round(sum(b1 * b2), 6) AS c12, round(sum(b2 * b2), 6) AS c22, round(sum(b1 * x), 5) AS x1, round(sum(b2 * y), 5) AS y2 FROM bs GROUP BY ALL"))
def bezier_normal(spark, sf_dir):
    return geometry.bezier_normal(rings(spark, sf_dir).withColumn("t", F.col("seq") / d(64)), RING)


@query(q(RINGS, select="SELECT image_id, ring, max(abs(x - y)) AS error, arg_min(seq, row(-abs(x - y), seq)) AS at FROM rg GROUP BY ALL"))
def worst_points(spark, sf_dir):
    return geometry.worst(rings(spark, sf_dir).withColumn("error", F.abs(F.col("x") - F.col("y"))), RING)


def _cubic(c: tuple, t: str = "t") -> tuple[str, str, str]:
    u = f"(1.0::DOUBLE - {t})"
    return (
        f"({u} * {u} * {u} * {c[0]} + 3.0::DOUBLE * {u} * {u} * {t} * {c[1]} + 3.0::DOUBLE * {u} * {t} * {t} * {c[2]} + {t} * {t} * {t} * {c[3]})",
        f"(3.0::DOUBLE * ({u} * {u} * ({c[1]} - {c[0]}) + 2.0::DOUBLE * {u} * {t} * ({c[2]} - {c[1]}) + {t} * {t} * ({c[3]} - {c[2]})))",
        f"(6.0::DOUBLE * ({u} * ({c[2]} - 2.0::DOUBLE * {c[1]} + {c[0]}) + {t} * ({c[3]} - 2.0::DOUBLE * {c[2]} + {c[1]})))",
    )


CX, CY = ("0.0::DOUBLE", "40.0::DOUBLE", "200.0::DOUBLE", "255.0::DOUBLE"), ("0.0::DOUBLE", "120.0::DOUBLE", "30.0::DOUBLE", "255.0::DOUBLE")
NEWTON = "SELECT image_id, y, x, round(CASE WHEN abs(sl) > 1e-12 THEN least(1, greatest(0, t - nu / sl)) ELSE t END, 6) AS t FROM (SELECT *, dx * dx + dy * dy + (px_ - r) * ex + (py_ - g) * ey AS sl, (px_ - r) * dx + (py_ - g) * dy AS nu FROM cu)"


@query(q("tt AS (SELECT *, x / 64.0::DOUBLE AS t FROM px)", "cu AS (SELECT *, " + ", ".join(f"{e} AS {n}" for c, ns in ((CX, ("px_", "dx", "ex")), (CY, ("py_", "dy", "ey"))) for e, n in zip(_cubic(c), ns, strict=True)) + " FROM tt)", select=NEWTON))
def newton_step(spark, sf_dir):
    control = [[d(v) for v in c] for c in ((0, 40, 200, 255), (0, 120, 30, 255))]
    return raster(spark, sf_dir).select("image_id", "y", "x", F.round(geometry.newton(*control, F.col("r").cast("double"), F.col("g").cast("double"), F.col("x") / d(64)), 6).alias("t"))


# strings, settings, batches


@query("SELECT event_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' END AS size FROM (SELECT event_id, event_id * 977 + 5 AS n FROM events)")
def byte_sizes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.human_bytes(F.col("event_id") * 977 + 5).alias("size"))


@query(q("tk AS (SELECT image_id, y, x, CAST(r AS VARCHAR) AS t1, CASE WHEN g % 2 = 0 THEN '-' ELSE '' END || CASE WHEN g % 3 = 0 THEN '.5' ELSE CAST(g AS VARCHAR) END AS t2, CASE WHEN b % 2 = 0 THEN '.25' ELSE '-1' END AS t3 FROM px)", select="SELECT image_id, y, x, t1 || CASE WHEN t2[1] = '-' THEN '' ELSE ' ' END || t2 || CASE WHEN t3[1] = '-' OR t3[1] = '.' AND contains(t2, '.') THEN '' ELSE ' ' END || t3 AS joined FROM tk"))
def joined_numbers(spark, sf_dir):
    sign = F.when(F.col("g") % 2 == 0, "-").otherwise("")
    second = F.concat(sign, F.when(F.col("g") % 3 == 0, ".5").otherwise(F.col("g").cast("string")))
    return raster(spark, sf_dir).select("image_id", "y", "x", text.join_numbers(F.array(F.col("r").cast("string"), second, F.when(F.col("b") % 2 == 0, ".25").otherwise("-1"))).alias("joined"))


@query(q(select="SELECT image_id, y, x, concat_ws('; ', CASE WHEN r > 128 AND g > 128 THEN 'photographic content under a drawing preset' END, CASE WHEN b > 128 THEN 'the image was reduced' END) AS notes FROM px"))
def trace_warnings(spark, sf_dir):
    kind, preset = F.when(F.col("r") > 128, "photo").otherwise("icon"), F.when(F.col("g") > 128, "icon").otherwise("poster")
    return raster(spark, sf_dir).select("image_id", "y", "x", F.array_join(batch.warnings(kind, preset, F.col("b") > 128), "; ").alias("notes"))


@query(q(select="""SELECT image_id, y, x, CAST(greatest(2, CASE WHEN c > 0 AND f >= 0.35 THEN least(w, greatest(4, c)) ELSE w END) AS INT) AS clusters, CASE WHEN greatest(p, q) > 1400 THEN 1 WHEN greatest(p, q) > 700 THEN 2 WHEN greatest(p, q) > 360 THEN 3 ELSE 4 END AS scale
  FROM (SELECT *, g % 30 AS c, r / 256.0::DOUBLE AS f, b * 6 AS p, r * 3 AS q, CAST(greatest(10, round_even(40 * (1.0::DOUBLE - 0.62::DOUBLE * (r / 256.0::DOUBLE)), 0)) AS INT) AS w FROM px)"""))
def adapted_settings(spark, sf_dir):
    clusters = batch.adapted_clusters(F.col("r") / d(256), (F.col("g") % 30).cast("int"), F.lit(40))
    return raster(spark, sf_dir).select("image_id", "y", "x", clusters.cast("int").alias("clusters"), batch.supersample_cap(F.col("b") * 6, F.col("r") * 3).alias("scale"))


@query("SELECT d.key, COALESCE(o.value, d.value) AS value FROM (SELECT DISTINCT 'k' || (event_id % 50) AS key, 'default' AS value FROM events) d LEFT JOIN (SELECT 'k' || (event_id % 50) AS key, max(event_type) AS value FROM events WHERE event_id % 50 < 20 OR user_id < 0 GROUP BY 1) o USING (key)")
def settings_overlay(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("key", F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")))
    own = events.groupBy("key").agg(F.max("event_type").alias("value"), F.max(F.col("event_id") % 50).alias("slot")).filter("slot < 20").drop("slot")
    return batch.overlay(events.select("key").distinct().withColumn("value", F.lit("default")), own)


RESULTS = "SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS name, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 2) END AS similarity, event_id % 1000 AS svg_bytes, round(value / 100, 3) AS seconds, CASE WHEN event_id % 97 = 0 THEN event_type END AS note FROM events"


@query(f"WITH rs AS ({RESULTS}) SELECT count(*) AS images, round(avg(similarity), 6) AS mean_similarity, CAST(sum(svg_bytes) AS BIGINT) AS svg_bytes, round(sum(seconds), 6) AS seconds, (SELECT string_agg(note, '; ' ORDER BY name) FROM (SELECT name, note FROM rs WHERE note IS NOT NULL ORDER BY name LIMIT 6)) AS notes, greatest(0, count(note) - 6) AS more_notes FROM rs")
def batch_summary(spark, sf_dir):
    """Values are rounded as doubles, scaled and scaled back: F.round goes by their shortest decimal form and so parts from SQL at halves that no double holds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    places = lambda c, n: F.round(c * d(10**n)) / d(10**n)
    return batch.batch_summary(e.select(name.alias("name"), F.when(F.col("event_id") % 3 != 0, places(F.col("value"), 2)).alias("similarity"), (F.col("event_id") % 1000).alias("svg_bytes"), places(F.col("value") / 100, 3).alias("seconds"), F.when(F.col("event_id") % 97 == 0, F.col("event_type")).alias("note")))


JOBS = "jb AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events), dn AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase')"


def _jobs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.select("user_id", "day").distinct(), e.filter("event_type = 'purchase'").select("user_id", "day").distinct()


@query(f"WITH {JOBS} SELECT count(*) AS outdated FROM jb WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM dn)")
def outdated_count(spark, sf_dir):
    return batch.outdated_count(*_jobs(spark, sf_dir), ["user_id", "day"])


@query("SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def selected_jobs(spark, sf_dir):
    jobs, done = _jobs(spark, sf_dir)
    only = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error' AND value > 90").select("user_id").distinct()
    return batch.selected(jobs, done, ["user_id", "day"], only)


_SUFFIX = ", ".join(f"'{s}'" for s in SUFFIXES)
FILES = "fi AS (SELECT doc_id AS ord, source || '/' || (doc_id % 60) || CASE WHEN doc_id % 4 = 0 THEN '.PNG' WHEN doc_id % 4 = 1 THEN '.jpeg' WHEN doc_id % 4 = 2 THEN '.txt' ELSE '.webp' END AS path, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE n_chars END AS length FROM documents)"


def _files(spark, sf_dir):
    i = F.col("doc_id")
    suffix = F.when(i % 4 == 0, ".PNG").when(i % 4 == 1, ".jpeg").when(i % 4 == 2, ".txt").otherwise(".webp")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(i.alias("ord"), F.concat(F.col("source"), F.lit("/"), (i % 60).cast("string"), suffix).alias("path"), F.when(i % 7 != 3, F.col("n_chars")).alias("length"))


@query(f"WITH {FILES} SELECT ord, path, CASE WHEN length IS NULL THEN 'missing' WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ({_SUFFIX}) THEN 'unsupported' WHEN row_number() OVER (PARTITION BY path ORDER BY ord) > 1 THEN 'duplicate' END AS reason FROM fi")
def rejected_files(spark, sf_dir):
    return batch.rejected(_files(spark, sf_dir), SUFFIXES).select("ord", "path", "reason")


@query(f"WITH {FILES} SELECT path, min(ord) AS ord FROM fi WHERE length IS NOT NULL AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({_SUFFIX}) GROUP BY path")
def collected_files(spark, sf_dir):
    """The files of a listing that are taken, each path where it first came."""
    return batch.collected(_files(spark, sf_dir), SUFFIXES)


@query(f"WITH {FILES}, ds AS (SELECT ord, 'out/' || regexp_extract(regexp_replace(path, '\\.[^./]*$', '') || '.svg', '([^/]+)$', 1) AS destination FROM fi) SELECT ord, destination, count(*) OVER (PARTITION BY destination) - 1 AS rivals FROM ds")
def destinations(spark, sf_dir):
    return batch.collisions(_files(spark, sf_dir).select("ord", text.destination(F.col("path"), "out").alias("destination")))


UPLOADS = "up AS (SELECT doc_id, doc_id || CASE WHEN doc_id % 5 = 0 THEN '.gifx' ELSE '.gif' END AS name, CASE WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 6 = 2 THEN to_base64(encode(COALESCE(text, ''))) || '!' ELSE to_base64(encode(COALESCE(text, ''))) END AS payload, octet_length(encode(COALESCE(text, ''))) AS n FROM documents)"


@query(f"WITH {UPLOADS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'suffix' WHEN payload = '' THEN 'empty' WHEN ends_with(payload, '!') THEN 'not base64' WHEN n > 2000 THEN 'too large' END AS reason, CASE WHEN doc_id % 5 <> 0 AND payload <> '' AND NOT ends_with(payload, '!') AND n <= 2000 THEN n ELSE -1 END AS bytes FROM up")
def upload_checks(spark, sf_dir):
    i, whole = F.col("doc_id"), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    plain = F.regexp_replace(whole, "[\r\n]", "")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(i.cast("string"), F.when(i % 5 == 0, ".gifx").otherwise(".gif")).alias("name"), F.when(i % 6 == 1, "").when(i % 6 == 2, F.concat(plain, F.lit("!"))).otherwise(plain).alias("payload"))
    return batch.uploads(rows, SUFFIXES, 2000).select("doc_id", "reason", F.coalesce(F.octet_length("content").cast("long"), F.lit(-1)).alias("bytes"))


@query(q("hw AS (SELECT image_id, max(y) AS h, max(x) AS w FROM px GROUP BY image_id)", "ori AS (SELECT px.*, h, w, image_id % 8 + 1 AS o FROM px JOIN hw USING (image_id))", select="SELECT image_id, CAST(CASE WHEN o IN (3, 4) THEN h - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN w - x ELSE y END AS INT) AS y, CAST(CASE WHEN o IN (2, 3) THEN w - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN h - y ELSE x END AS INT) AS x, r, g, b, a FROM ori"))
def oriented_pixels(spark, sf_dir):
    return pixels.oriented(raster(spark, sf_dir), F.col("image_id") % 8 + 1)


@query("SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 6 ELSE 0 END AS DOUBLE) / 7.0::DOUBLE AS progress FROM events")
def stage_progress(spark, sf_dir):
    stage = F.create_map(*map(F.lit, ("view", "queued", "click", "load", "purchase", "merge", "signup", "write")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", batch.progress(F.coalesce(F.try_element_at(stage, F.col("event_type")), F.lit("other"))).alias("progress"))


ACTIONS = '''lg AS (SELECT user_id * 100 + event_id % 100 AS job, event_id AS "at", CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'remove' END AS action FROM events)'''


@query(f"""WITH {ACTIONS}, bf AS (SELECT *, last_value(CASE WHEN action <> 'remove' THEN action END IGNORE NULLS) OVER (PARTITION BY job ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lg),
re AS (SELECT *, action = 'remove' AND COALESCE(before = 'start', false) AS refused FROM bf), ls AS (SELECT job, arg_max(action, "at") FILTER (NOT refused) AS action, count(*) FILTER (refused) AS refused FROM re GROUP BY job)
SELECT job, CASE action WHEN 'start' THEN 'running' WHEN 'add' THEN 'queued' ELSE action END AS state, refused FROM ls WHERE action <> 'remove'""")
def queue_states(spark, sf_dir):
    action = F.create_map(*map(F.lit, ("view", "add", "click", "start", "purchase", "done", "error", "failed", "signup", "remove")))
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("job"), F.col("event_id").alias("at"), F.element_at(action, F.col("event_type")).alias("action"))
    return batch.queue_states(log)


@query("SELECT user_id, substr(sha256(CAST(user_id AS VARCHAR) || '/' || min(event_id)), 1, 12) AS job FROM events GROUP BY user_id")
def job_ids(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("e"))
    return first.select("user_id", batch.job_id(F.col("user_id"), F.col("e")).alias("job"))


def _drawn(shrink: int) -> str:
    parts = []
    for k, ((_, width, height, _), drawing) in enumerate(zip(DRAWN, DRAWINGS, strict=True)):
        w, h = width // shrink, height // shrink
        places = f"SELECT CAST(i // {w} AS INT) AS y, CAST(i % {w} AS INT) AS x, {w}::DOUBLE AS w, {h}::DOUBLE AS h FROM range({w * h}) t(i)"
        parts.append(f"SELECT {k}::BIGINT AS image_id, y, x, CAST({drawing} AS INT) AS c FROM (SELECT *, x / w AS u, y / h AS v FROM ({places}))")
    return f"SELECT image_id, y, x, COALESCE(c // 65536, 0) AS r, COALESCE(c // 256 % 256, 0) AS g, COALESCE(c % 256, 0) AS b, CASE WHEN c IS NULL THEN 0 ELSE 255 END AS a FROM ({' UNION ALL '.join(parts)})"


@query(_drawn(4))
def drawn_corpus(spark, sf_dir):
    """The images that traces are timed and scored on, a quarter as wide and high."""
    return drawn(spark, 4)


@query(q(LABELS, summary("lb", "label"), select="SELECT label, round(avg(mean_r), 6) AS similarity, round(avg(mean_g), 6) AS edges FROM st GROUP BY label"))
def benchmark_means(spark, sf_dir):
    """Unweighted means of scores by preset, here of the labels of all rasters."""
    return _stats(spark, sf_dir)[0].groupBy("label").agg(F.round(F.avg("mean_r"), 6).alias("similarity"), F.round(F.avg("mean_g"), 6).alias("edges"))

