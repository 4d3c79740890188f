"""Separable resampling: each axis is one join of the pixels with a table of weights and one aggregation.

The weights depend on the pair of lengths alone, so their table grows with the different sizes of images, not with the
images; it is broadcast where a count of its rows says that it is small. Sums are rounded to six places before they become levels, so that
the order of addition does not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import broadcast_if_small
from .pixels import d

CHANNELS = ("r", "g", "b", "a")
#: How far each kernel reaches, in pixels of the coarser grid.
REACH = {"nearest": 0.5, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def _sinc(t: Column) -> Column:
    u = t * d(math.pi)
    return F.when(t == 0, d(1)).otherwise(F.sin(u) / F.when(u == 0, d(1)).otherwise(u))


def kernel(method: str, t: Column) -> Column:
    u = F.abs(t)
    if method == "nearest":
        return d(1)
    if method == "bilinear":
        return F.greatest(d(0), d(1) - u)
    if method == "bicubic":  # with slope -1/2
        return F.when(u < 1, (d(1.5) * u - d(2.5)) * u * u + d(1)).when(u < 2, ((d(-0.5) * u + d(2.5)) * u - d(4)) * u + d(2)).otherwise(d(0))
    return F.when(u < 3, _sinc(t) * _sinc(t / d(3))).otherwise(d(0))


def taps(lengths: DataFrame, method: str) -> DataFrame:
    """(n_in, n_out, s, o, w): what source place s gives to place o. An unknown method is lanczos."""
    method = method if method in REACH else "lanczos"
    scale = F.col("n_in").cast("double") / F.col("n_out").cast("double")
    wide = F.greatest(scale, d(1))
    placed = lengths.select("n_in", "n_out", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"), scale.alias("scale"), wide.alias("wide"))
    placed = placed.withColumn("center", (F.col("o") + d(0.5)) * F.col("scale"))
    if method == "nearest":
        return placed.select("n_in", "n_out", F.least(F.floor("center").cast("int"), F.col("n_in") - 1).alias("s"), "o", d(1).alias("w"))
    reach = d(REACH[method]) * F.col("wide")
    first = F.greatest(F.lit(0), F.floor(F.col("center") - reach + d(0.5)).cast("int"))
    last = F.least(F.col("n_in"), F.floor(F.col("center") + reach + d(0.5)).cast("int")) - 1
    raw = placed.withColumn("at", F.sequence(first, last)).withColumn("k", F.transform("at", lambda s: kernel(method, (s - F.col("center") + d(0.5)) / F.col("wide"))))
    total = F.aggregate("k", d(0), lambda acc, k: acc + k)
    return raw.withColumn("__total", total).select("n_in", "n_out", "o", "__total", F.inline(F.arrays_zip("at", "k"))).select("n_in", "n_out", F.col("at").alias("s"), "o", (F.col("k") / F.col("__total")).alias("w"))


def _level(value: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round(value, 6) + d(0.5)))).cast("int")


def _along(pixels: DataFrame, sizes: DataFrame, axis: str, method: str) -> DataFrame:
    """pixels with width, height and the wanted to_width, to_height, all in sizes, resampled along x or y."""
    n_in, n_out = ("width", "to_width") if axis == "x" else ("height", "to_height")
    other = "y" if axis == "x" else "x"
    table = taps(sizes.select(F.col(n_in).alias("n_in"), F.col(n_out).alias("n_out")).distinct(), method).withColumnsRenamed({"n_in": n_in, "n_out": n_out, "s": axis})
    size = ["width", "height", "to_width", "to_height"]
    met = pixels.join(broadcast_if_small(table), [n_in, n_out, axis])
    return met.groupBy("image_id", other, F.col("o").alias("__o"), *size).agg(*(_level(F.sum(F.col(c) * F.col("w"))).alias(c) for c in CHANNELS)).withColumnRenamed("__o", axis)


def _resize(pixels: DataFrame, to_width: Column, to_height: Column, method: str, size: tuple[int, int] | None) -> DataFrame:
    wanted = {"to_width": to_width.cast("int"), "to_height": to_height.cast("int")}
    if size:
        sizes = pixels.sparkSession.range(1).select(F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height")).withColumns(wanted)
        sized = pixels.withColumns({"width": F.lit(size[0]), "height": F.lit(size[1])}).withColumns(wanted)
    else:
        sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).withColumns(wanted)
        sized = pixels.join(sizes, "image_id")
    pre = [F.floor(F.col(c) * F.col("a") / d(255) + d(0.5)).cast("int").alias(c) for c in CHANNELS[:3]]
    laid = sized.select("image_id", "y", "x", *pre, "a", "width", "height", *wanted)
    done = _along(_along(laid, sizes, "x", method), sizes, "y", method)
    post = [F.when(F.col("a") == 0, 0).otherwise(F.least(F.lit(255), F.floor(F.col(c) * 255 / F.greatest("a", F.lit(1))))).cast("int").alias(c) for c in CHANNELS[:3]]
    return done.select("image_id", "y", "x", *post, "a")


def cap_size(pixels: DataFrame, max_edge: int = 1024, method: str = "lanczos", size: tuple[int, int] | None = None) -> DataFrame:
    """Rasters whose longer side is over max_edge, made smaller to have just that; others, and all if max_edge is 0, as they are.

    size: the width and height of every raster where they are known; pixels that a raster has not got then count as nothing. Without it the last pixels tell."""
    if not max_edge or size and max(size) <= max_edge:
        return pixels.select("image_id", "y", "x", *CHANNELS)
    longest = F.greatest("width", "height")
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * (d(max_edge) / longest)))
    if size:
        return _resize(pixels, side("width"), side("height"), method, size)
    over = pixels.groupBy("image_id").agg(F.greatest(F.max("x"), F.max("y")).alias("m")).filter(F.col("m") >= max_edge).select("image_id")
    small = _resize(pixels.join(over, "image_id", "left_semi"), side("width"), side("height"), method, None)
    return pixels.join(over, "image_id", "left_anti").select("image_id", "y", "x", *CHANNELS).unionByName(small)


def supersample(pixels: DataFrame, scale: int, method: str = "lanczos", size: tuple[int, int] | None = None) -> DataFrame:
    """Rasters with scale times the width and the height; as they are at scale 1. size as in cap_size."""
    if scale == 1:
        return pixels.select("image_id", "y", "x", *CHANNELS)
    return _resize(pixels, F.col("width") * scale, F.col("height") * scale, method, size)
