"""Per-pixel projections; every row is handled alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def d(value: float) -> Column:
    return F.lit(float(value))


def luma(r="r", g="g", b="b") -> Column:
    return F.col(r) * d(0.299) + F.col(g) * d(0.587) + F.col(b) * d(0.114)


def packed15(r="r", g="g", b="b") -> Column:
    """Five bits of each channel."""
    return F.shiftleft(F.shiftright(r, 3), 10) + F.shiftleft(F.shiftright(g, 3), 5) + F.shiftright(b, 3)


def flattened(channel: str, ground: int = 160) -> Column:
    """A channel over a grey ground by its alpha."""
    alpha = F.col("a") / d(255)
    return F.col(channel) * alpha + d(ground) * (d(1) - alpha)


def premultiplied(channel: str) -> Column:
    return F.col(channel) * (F.col("a") / d(255))


def redmean(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    """Weighted colour distance with weights that follow the mean red."""
    (r1, g1, b1), (r2, g2, b2) = ([F.col(c).cast("double") for c in x] for x in (a, b))
    mean = (r1 + r2) / d(2)
    return F.sqrt(((d(2) + mean / d(256)) * (r1 - r2) * (r1 - r2) + d(4) * (g1 - g2) * (g1 - g2) + (d(2) + (d(255) - mean) / d(256)) * (b1 - b2) * (b1 - b2)) / d(3))


def lab(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """CIE L*a*b* of 8-bit sRGB for the D65 white and the two-degree observer."""

    def linear(c: str) -> Column:
        v = F.col(c) / d(255)
        return F.when(v > d(0.04045), F.pow((v + d(0.055)) / d(1.055), d(2.4))).otherwise(v / d(12.92))

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (lr * d(0.412453) + lg * d(0.357580) + lb * d(0.180423)) / d(0.95047)
    y = lr * d(0.212671) + lg * d(0.715160) + lb * d(0.072169)
    z = (lr * d(0.019334) + lg * d(0.119193) + lb * d(0.950227)) / d(1.08883)
    f = lambda t: F.when(t > d(0.008856), F.pow(t, d(1 / 3))).otherwise(d(7.787) * t + d(16 / 116))
    return d(116) * f(y) - d(16), d(500) * (f(x) - f(y)), d(200) * (f(y) - f(z))


def stride_sample(pixels: DataFrame, edge: int = 256) -> DataFrame:
    """Every so many rows and columns, so that the longer side keeps about edge samples."""
    size = pixels.groupBy("image_id").agg(F.greatest(F.max("y"), F.max("x")).alias("__last"))
    step = F.greatest(F.lit(1), F.expr(f"cast((__last + 1) div {edge} as int)"))
    return pixels.join(size, "image_id").filter((F.col("y") % step == 0) & (F.col("x") % step == 0)).drop("__last")


def subpixel(scale: float) -> tuple[Column, Column]:
    return (F.col("x") + d(0.5)) / d(scale), (F.col("y") + d(0.5)) / d(scale)


def oriented(pixels: DataFrame, orientation: Column) -> DataFrame:
    """Pixels turned and mirrored to stand upright, by the orientation number 1 to 8 of their file; others as they are."""
    size = pixels.groupBy("image_id").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    met = pixels.withColumn("__o", orientation).join(size, "image_id")
    y, x, h, w, o = (F.col(c) for c in ("y", "x", "__h", "__w", "__o"))
    ny = F.when(o.isin(3, 4), h - y).when(o.isin(5, 6), x).when(o.isin(7, 8), w - x).otherwise(y)
    nx = F.when(o.isin(2, 3), w - x).when(o.isin(5, 8), y).when(o.isin(6, 7), h - y).otherwise(x)
    return met.select("image_id", ny.alias("y"), nx.alias("x"), "r", "g", "b", "a")
