"""Paint models of regions: flat colour, linear and radial ramps by least squares, stops by quantile bins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.paints import PAIRS, centre
from .pixels import d
from .text import attribute_number


def flat_fit(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean colour of each region and the mean distance of its pixels from it."""
    mean = pixels.groupBy(*keys).agg(*(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in "rgb"))
    far = F.sqrt(sum(((F.col(c) - F.col(f"mean_{c}")) * (F.col(c) - F.col(f"mean_{c}")) for c in "rgb"), d(0)))
    return pixels.join(mean, keys).groupBy(*keys).agg(*(F.round(F.first(f"mean_{c}"), 6).alias(c) for c in "rgb"), F.round(F.avg(far), 6).alias("residual"))


def slopes(pixels: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Plane c = m + gx (x - mean x) + gy (y - mean y) of a channel, from sums alone; null where the points lie on one line."""
    c, x, y = (F.col(n).cast("double") for n in (channel, "x", "y"))
    sums = pixels.groupBy(*keys).agg(F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, c).alias("xc"), F.covar_pop(y, c).alias("yc"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(c).alias("mc"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solved = lambda top: F.when(det > d(1e-9), F.round(top / det, 6))
    return sums.select(*keys, F.round("mc", 6).alias("mean"), solved(F.col("xc") * F.col("yy") - F.col("yc") * F.col("xy")).alias("gx"), solved(F.col("yc") * F.col("xx") - F.col("xc") * F.col("xy")).alias("gy"))


def quantile_stops(points: DataFrame, keys: list[str], parameter: str, value: str, count: int = 5) -> DataFrame:
    """Mean parameter and value in each of count quantile bins; bins of fewer than two points are left out, the last one is closed."""
    shares = F.array(*(d(i / count) for i in range(count + 1)))
    edges = points.groupBy(*keys).agg(F.percentile(F.col(parameter).cast("double"), shares).alias("__e"))
    t = F.col(parameter).cast("double")
    bin_ = F.least(F.lit(count - 1), F.size(F.filter("__e", lambda e: e <= t)) - 1).cast("int")
    return points.join(edges, keys).withColumn("stop", bin_).groupBy(*keys, "stop").agg(F.count("*").alias("n"), F.round(F.avg(t), 6).alias("offset"), F.round(F.avg(F.col(value).cast("double")), 6).alias("value")).filter("n >= 2")


def interpolate(stops: Column, t: Column) -> Column:
    """Piecewise linear value at t of an array of struct<offset, value> in order of offset; the ends go on level."""
    below = F.filter(stops, lambda s: s["offset"] <= t)
    above = F.filter(stops, lambda s: s["offset"] > t)
    lo, hi = F.element_at(below, -1), F.get(above, 0)
    inner = lo["value"] + (hi["value"] - lo["value"]) * (t - lo["offset"]) / (hi["offset"] - lo["offset"])
    return F.when(F.size(below) == 0, F.get(stops, 0)["value"]).when(F.size(above) == 0, F.element_at(stops, -1)["value"]).otherwise(inner)


def linear_offset(x1: float, y1: float, x2: float, y2: float) -> Column:
    """Place of a pixel along the line from (x1, y1) to (x2, y2), 0 to 1; null for a line without length."""
    long = (x2 - x1) ** 2 + (y2 - y1) ** 2
    if not long:
        return F.lit(None).cast("double")
    along = ((F.col("x") - d(x1)) * d(x2 - x1) + (F.col("y") - d(y1)) * d(y2 - y1)) / d(long)
    return F.least(d(1), F.greatest(d(0), along))


def radial_offset(cx: float, cy: float, radius: float) -> Column:
    if radius <= 0:
        return F.lit(None).cast("double")
    return F.least(d(1), F.sqrt((F.col("x") - d(cx)) * (F.col("x") - d(cx)) + (F.col("y") - d(cy)) * (F.col("y") - d(cy))) / d(radius))


def extrapolated(near_at: Column, near: Column, far_at: Column, far: Column, to: Column, most: float = 255.0) -> Column:
    """A stop's value at to in line with the two nearest ones, within 0 and most."""
    by = F.coalesce(F.try_divide(to - near_at, F.nullif(near_at - far_at, d(0))), d(0))
    return F.least(d(most), F.greatest(d(0), near + (near - far) * by))


def alpha_error(actual: Column, predicted: Column, weight: float) -> Column:
    """An aggregate: the weighted mean error of alpha."""
    return F.avg(F.abs(actual - predicted)) * d(weight)


def residual(pixels: DataFrame, keys: list[str], painted: tuple[Column, Column, Column], alpha: Column, alpha_weight: float = 90.0) -> DataFrame:
    """Mean weighted distance of each region's pixels from their painted colour, and the weighted error of alpha; null painted colours give an infinite residual."""
    far = redmean_of([F.col(c).cast("double") for c in "rgb"], painted)
    sums = pixels.groupBy(*keys).agg(F.avg(far).alias("m"), alpha_error(F.col("a") / d(255), alpha, alpha_weight).alias("e"), F.count_if(painted[0].isNull()).alias("none"))
    return sums.select(*keys, F.when(F.col("none") > 0, d(float("inf"))).otherwise(F.round(F.col("m") + F.col("e"), 6)).alias("residual"))


def redmean_of(a, b) -> Column:
    mean = (a[0] + b[0]) / d(2)
    r, g, b_ = (x - y for x, y in zip(a, b, strict=True))
    return F.sqrt(((d(2) + mean / d(256)) * r * r + d(4) * g * g + (d(2) + (d(255) - mean) / d(256)) * b_ * b_) / d(3))


def directions(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The squared rise of all channels along the direction in which they rise most, and that direction's squared share of x: both without the arbitrary sign. From sums alone."""
    wide = [slopes(pixels, keys, c).select(*keys, F.col("gx").alias(f"{c}x"), F.col("gy").alias(f"{c}y")) for c in "rgb"]
    met = wide[0].join(wide[1], keys).join(wide[2], keys)
    xx, yy, xy = (sum((F.col(f"{c}{i}") * F.col(f"{c}{j}") for c in "rgb"), d(0)) for i, j in (("x", "x"), ("y", "y"), ("x", "y")))
    half = F.sqrt((xx - yy) * (xx - yy) / d(4) + xy * xy)
    share = F.try_divide((xx - yy) / d(2), F.nullif(half, d(0)))
    return met.filter("rx IS NOT NULL").select(*keys, F.round((xx + yy) / d(2) + half, 4).alias("rise"), F.round((d(1) + F.coalesce(share, d(0))) / d(2), 4).alias("x_share"))


def radial_valid(cx: Column, cy: Column, radius: Column, box: tuple[Column, Column, Column, Column], limit: float = 2.5) -> Column:
    """Whether a ring ramp's centre is near enough to its region's bounds (left, top, right, bottom) and its radius not nothing."""
    left, top, right, bottom = box
    away = F.sqrt((cx - (left + right) / d(2)) * (cx - (left + right) / d(2)) + (cy - (top + bottom) / d(2)) * (cy - (top + bottom) / d(2)))
    diagonal = F.sqrt((right - left) * (right - left) + (bottom - top) * (bottom - top))
    return (away <= d(limit) * diagonal) & (radius > d(1e-6))


def signal_channels(pixels: DataFrame, keys: list[str], least: float = 0.02) -> DataFrame:
    """Whether alpha takes part in the fit of each region, and its mean on the scale of the colours if it does."""
    share = F.col("a") / d(255)
    return pixels.groupBy(*keys).agg((F.max(share) - F.min(share) >= d(least)).alias("with_alpha"), F.avg(share * d(255)).alias("__a")).select(*keys, "with_alpha", F.when(F.col("with_alpha"), F.round("__a", 6)).alias("signal"))


def gradient_element(kind: Column, name: Column, shape: list[Column], stops: Column) -> Column:
    """The gradient element of a ramp from an array of struct<offset, color, alpha>; null for a flat paint."""
    keys = [F.when(kind == "linear", x).otherwise(y) for x, y in (("x1", "cx"), ("y1", "cy"), ("x2", "r"))]
    place = [F.concat(F.lit(" "), k, F.lit('="'), attribute_number(v), F.lit('"')) for k, v in zip(keys, shape, strict=False)]
    place.append(F.when(kind == "linear", F.concat(F.lit(' y2="'), attribute_number(shape[3]), F.lit('"'))).otherwise(""))
    opacity = lambda s: F.when(s["alpha"] < d(0.995), F.concat(F.lit(' stop-opacity="'), attribute_number(s["alpha"], 3), F.lit('"'))).otherwise("")
    one = lambda s: F.concat(F.lit('<stop offset="'), attribute_number(s["offset"], 3), F.lit('" stop-color="'), s["color"], F.lit('"'), opacity(s), F.lit("/>"))
    body = F.array_join(F.transform(stops, one), "")
    return F.when(kind != "flat", F.concat(F.lit("<"), kind, F.lit('Gradient id="'), name, F.lit('" gradientUnits="userSpaceOnUse"'), *place, F.lit(">"), body, F.lit("</"), kind, F.lit("Gradient>")))


def paint_attributes(kind: Column, name: Column, color: Column, alpha: Column) -> Column:
    opacity = F.when(alpha < d(0.995), F.concat(F.lit(' fill-opacity="'), attribute_number(alpha, 3), F.lit('"'))).otherwise("")
    return F.when(kind == "flat", F.concat(F.lit('fill="'), color, F.lit('"'), opacity)).otherwise(F.concat(F.lit('fill="url(#'), name, F.lit(')"')))


def centres(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The centre that the channels' paraboloids c = m + bx x + by y + d (x x + y y) share, weighted by their curvature d; from sums alone.

    The plane part is taken out of x x + y y first; regions of a line, or without curvature, have none. Points on one circle, such as any three, have no
    curvature either, which doubles tell from a slight one only by chance: sums are whole numbers, those of products with z = x x + y y in two halves of 32 bits,
    and one division of whole numbers gives each coordinate. A place more than 55,108 pixels from the corner, beyond which z z takes over 64 bits, is an error."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    far = F.raise_error(F.lit("centres: a pixel lies more than 55108 pixels from the corner")).cast("long")
    of = {"x": x, "y": y, "z": F.col("__z"), **{c: F.col(c).cast("long") for c in "rgb"}}
    pairs = {p: of[p[0]] * of[p[1]] for p in PAIRS}
    parts = {n: F.sum(c) for n, c in (of | {p: v for p, v in pairs.items() if "z" not in p}).items()}
    for p in (p for p in PAIRS if "z" in p):
        parts |= {p: F.sum(pairs[p].bitwiseAND(F.lit(0xFFFFFFFF))), f"{p}_high": F.sum(F.shiftright(pairs[p], 32))}
    sums = pixels.withColumn("__z", x * x + y * y).withColumn("__z", F.when(F.col("__z") <= 3_037_000_499, F.col("__z")).otherwise(far))
    sums = sums.groupBy(*keys).agg(F.count("*").alias("__n"), *(c.alias(f"__{n}") for n, c in parts.items()))
    names = ["n", *parts]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(f"__{n}").to_pylist() for n in names), strict=True)
            at = [centre(dict(zip(names, row, strict=True))) for row in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([None if c is None else c[i] for c in at], pa.float64()) for i in (0, 1))], [*keys, "cx", "cy"])

    shape = StructType([pixels.schema[k] for k in keys] + [StructField("cx", DoubleType()), StructField("cy", DoubleType())])
    found = sums.mapInArrow(solved, shape).filter("cx IS NOT NULL")
    return found.select(*keys, *((F.round(F.col(c) * d(1000)) / d(1000) + d(0)).alias(c) for c in ("cx", "cy")))
