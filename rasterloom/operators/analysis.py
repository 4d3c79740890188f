"""Content analysis: one aggregation over a windowed sample gives texture, flatness, colours, and the kind of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbourhood import median9, spread9, with_block
from .pixels import d, lab, luma, packed15
from .regions import clear_backdrop, components

#: Limits of the content classes.
TEXTURE, SPREAD, FLATNESS, COLOURS, LEAST_SAMPLES, STEP = 1.6, 0.35, 0.6, 900, 32, 6


def analyze(pixels: DataFrame) -> DataFrame:
    """image_id, samples, texture, spread, flatness, unique_colors, transparency, kind and confidence of each image."""
    seen = with_block(pixels, luma())
    opaque = F.col("a") > d(127.5)
    share = lambda c: F.avg(F.when(opaque, c.cast("double")))
    figures = seen.withColumn("__range", spread9()).groupBy("image_id").agg(
        F.count_if(opaque).alias("samples"),
        share(F.abs(luma() - median9())).alias("t"),
        share(F.col("__range") > STEP).alias("s"),
        share(F.col("__range") < STEP).alias("f"),
        F.count_distinct(F.when(opaque, packed15())).alias("unique_colors"),
        F.avg((F.col("a") < d(0.99 * 255)).cast("double")).alias("transparency"),
    )
    enough = F.col("samples") >= LEAST_SAMPLES
    photo = (F.col("t") >= d(TEXTURE)) & (F.col("s") >= d(SPREAD))
    icon = (F.col("f") > d(FLATNESS)) & (F.col("unique_colors") < COLOURS)
    kind = F.when(~enough, "illustration").when(photo, "photo").when(icon, "icon").otherwise("illustration")
    sure = F.when(~enough, d(0)).when(photo, F.least(d(1), F.col("t") / d(3.2))).when(icon, F.least(d(1), F.col("f"))).otherwise(d(0.5) + F.least(d(0.45), F.abs(F.col("t") - d(TEXTURE)) / d(3.2)))
    at = lambda c, none: F.round(F.when(enough, F.col(c)).otherwise(d(none)), 6)
    return figures.select("image_id", "samples", at("t", 0).alias("texture"), at("s", 0).alias("spread"), at("f", 1).alias("flatness"), "unique_colors", F.round("transparency", 6).alias("transparency"), kind.alias("kind"), F.round(sure, 6).alias("confidence"))


def border_statistics(pixels: DataFrame) -> DataFrame:
    """Per image the median colour of its border (corners counted twice) and the mean deviation from it."""
    size = pixels.groupBy("image_id").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    sides = F.array_compact(F.array(F.when(F.col("y") == 0, 1), F.when(F.col("y") == F.col("__h"), 1), F.when(F.col("x") == 0, 1), F.when(F.col("x") == F.col("__w"), 1)))
    edge = pixels.join(size, "image_id").withColumn("__side", F.explode(sides))
    middle = edge.groupBy("image_id").agg(*(F.percentile(c, F.lit(0.5)).alias(f"m{c}") for c in "rgb"))
    off = sum((F.abs(F.col(c) - F.col(f"m{c}")) for c in "rgb"), d(0)) / d(3)
    return edge.join(middle, "image_id").groupBy("image_id", "mr", "mg", "mb").agg(F.avg(off).alias("deviation"))


def backdrop_candidates(pixels: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """Pixels with some alpha whose largest channel difference from the border's median is at most tolerance."""
    border = border_statistics(pixels)
    far = F.greatest(*(F.abs(F.col(c) - F.col(f"m{c}")) for c in "rgb"))
    return pixels.join(border, "image_id").filter((far <= d(tolerance)) & (F.col("a") > 0)).select(pixels.columns)


def silhouette(pixels: DataFrame) -> DataFrame:
    """Pixels of at least half coverage, or in an image without any, those with some."""
    most = pixels.groupBy("image_id").agg(F.max("a").alias("__most"))
    return pixels.join(most, "image_id").filter(F.when(F.col("__most") >= 128, F.col("a") >= 128).otherwise(F.col("a") > 0)).drop("__most")


def translucency(pixels: DataFrame, limit: float = 0.06) -> DataFrame:
    """image_id, the share of pixels with alpha below 0.9, and whether it exceeds limit."""
    share = F.avg((F.col("a") < d(0.9 * 255)).cast("double"))
    return pixels.groupBy("image_id").agg(F.round(share, 6).alias("share"), (share > d(limit)).alias("translucent"))


def features(pixels: DataFrame, alpha_weight: float = 45.0) -> DataFrame:
    """Lab of each pixel, and alpha times alpha_weight in translucent images, else null."""
    l, a, b = lab()  # noqa: E741
    marked = pixels.join(translucency(pixels).select("image_id", "translucent"), "image_id")
    return marked.withColumns({"f1": l, "f2": a, "f3": b, "f4": F.when(F.col("translucent"), F.col("a") / d(255) * d(alpha_weight))})


def backdrop_verdict(pixels: DataFrame, tolerance: float = 12.0, uniform: float = 12.0, least: float = 0.02, most: float = 0.97, islands: int = 32) -> DataFrame:
    """Per image the border's deviation, the share of pixels that a backdrop reaching in from the edge would clear, the islands that would be left
    inside, and whether it should go: not where the border is uneven, the share not believable or the islands many."""
    cleared = clear_backdrop(pixels, backdrop_candidates(pixels, tolerance))
    flagged = pixels.select("image_id", "y", "x", F.col("a").alias("was")).join(cleared.select("image_id", "y", "x", "a"), ["image_id", "y", "x"])
    flagged = flagged.withColumn("label", ((F.col("a") > 0) | (F.col("was") == 0)).cast("int"))
    shares = flagged.groupBy("image_id").agg(F.avg(1 - F.col("label").cast("double")).alias("share"), F.max("y").alias("h"), F.max("x").alias("w"))
    parts = components(flagged.select("image_id", "y", "x", "label")).filter("component > 0").join(shares.select("image_id", "h", "w"), "image_id")
    inner = parts.groupBy("image_id", "component").agg(F.max(F.expr("y = 0 OR x = 0 OR y = h OR x = w")).alias("outer")).groupBy("image_id").agg(F.count_if(~F.col("outer")).alias("islands"))
    told = border_statistics(pixels).select("image_id", "deviation").join(shares, "image_id").join(inner, "image_id", "left").withColumn("islands", F.coalesce("islands", F.lit(0)))
    goes = (F.col("deviation") <= d(uniform)) & F.col("share").between(d(least), d(most)) & (F.col("islands") <= islands)
    return told.select("image_id", F.round("deviation", 6).alias("deviation"), F.round("share", 6).alias("share"), "islands", goes.alias("goes"))


def summary_line(kind: str = "kind", texture: str = "texture", flatness: str = "flatness") -> Column:
    return F.format_string("%s: texture %.2f, %.0f %% flat", F.col(kind), F.col(texture), F.col(flatness) * d(100))
