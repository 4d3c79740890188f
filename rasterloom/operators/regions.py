"""Regions: components, adjacency, clusters and the order in which small ones go."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import label4
from ..functions.lineage import cut
from .geometry import boxes_overlap
from .neighbourhood import along_column, along_row, interior
from .pixels import d


#: Centres of a palette at most: they travel to the pixels in one array.
MOST_CENTRES = 4096


def components(labels: DataFrame, label: str = "label") -> DataFrame:
    """component: number of each 4-connected area of one label, in raster order from 1 within an image; label 0 is none.

    An image is one group: labelling is sequential, and an image is of bounded size."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(), frame["x"].to_numpy()
        grid = np.zeros((y.max() + 1, x.max() + 1), np.int64)
        grid[y, x] = frame[label].to_numpy()
        frame["component"] = label4(grid)[y, x]
        return frame

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in labels.schema)
    return labels.groupBy("image_id").applyInPandas(one, f"{kinds}, component int")


def summary(parts: DataFrame, key: str = "component") -> DataFrame:
    """Size, half-open bounds and mean colour of each part; part 0 is none."""
    means = [F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in "rgb"]
    return parts.filter(F.col(key) > 0).groupBy("image_id", key).agg(F.count("*").alias("area"), F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"), F.min("x").alias("left"), (F.max("x") + 1).alias("right"), *means)


def adjacency(parts: DataFrame, key: str = "component") -> DataFrame:
    """Unordered pairs lo < hi of parts that touch across a pixel's side. Neighbours come from windows; there is no self-join."""
    v = F.col(key)
    ahead = parts.select("image_id", v.alias("one"), F.array(F.lead(v).over(along_row()), F.lead(v).over(along_column())).alias("__ahead"))
    pairs = ahead.select("image_id", "one", F.explode("__ahead").alias("other")).filter("one > 0 AND other > 0 AND one <> other")
    return pairs.select("image_id", F.least("one", "other").alias("lo"), F.greatest("one", "other").alias("hi")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("image_id", F.col("lo").alias("node"), F.col("hi").alias("other")).union(edges.select("image_id", F.col("hi").alias("node"), F.col("lo").alias("other")))


def neighbours(parts: DataFrame, edges: DataFrame, key: str = "component") -> DataFrame:
    """Every part with the sorted array of its neighbours, empty for an isolated one."""
    sets = symmetric(edges).groupBy("image_id", F.col("node").alias(key)).agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    return parts.filter(F.col(key) > 0).select("image_id", key).distinct().join(sets, ["image_id", key], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<int>")))


def contrast(stats: DataFrame, edges: DataFrame, key: str = "component") -> DataFrame:
    """Least colour distance of each part to a neighbour (null without one) and its worth, size times contrast."""
    colour = lambda p, n: stats.select("image_id", F.col(key).alias(n), *(F.col(f"mean_{c}").alias(f"{p}{c}") for c in "rgb"))
    met = symmetric(edges).join(colour("p", "node"), ["image_id", "node"]).join(colour("q", "other"), ["image_id", "other"])
    far = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "rgb"), d(0)))
    least = met.groupBy("image_id", F.col("node").alias(key)).agg(F.min(far).alias("contrast"))
    return stats.join(least, ["image_id", key], "left").select("image_id", key, "area", F.round("contrast", 6).alias("contrast"), F.round(F.col("area") * F.col("contrast"), 6).alias("worth"))


def doomed(worth: DataFrame, min_area: int, budget: int, key: str = "component") -> DataFrame:
    """Parts below min_area, and of the rest those of least worth beyond the budget; parts of unlimited worth go last."""
    order = Window.partitionBy("image_id", "speck").orderBy(F.col("worth").asc_nulls_last(), key)
    ranked = worth.withColumn("speck", F.col("area") < min_area).withColumn("__rank", F.row_number().over(order))
    rest = F.count_if(~F.col("speck")).over(Window.partitionBy("image_id"))
    return ranked.withColumn("__rest", rest).filter(F.col("speck") | (F.col("__rank") <= F.col("__rest") - budget)).select("image_id", key, "speck")


def assign(pixels: DataFrame, centres: DataFrame) -> DataFrame:
    """label: the nearest centre (k, cr, cg, cb) of each pixel, the first on ties. Centres are a palette of bounded size, collected into one array."""
    if centres.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"a palette has at most {MOST_CENTRES} centres")
    few = centres.agg(F.array_sort(F.collect_list(F.struct("k", "cr", "cg", "cb"))).alias("__c"))
    far = lambda c: (F.col("r") - c["cr"]) * (F.col("r") - c["cr"]) + (F.col("g") - c["cg"]) * (F.col("g") - c["cg"]) + (F.col("b") - c["cb"]) * (F.col("b") - c["cb"])
    near = F.array_min(F.transform("__c", lambda c: F.struct(far(c).alias("far"), c["k"].alias("k"))))
    return pixels.crossJoin(F.broadcast(few)).withColumn("__n", near).withColumn("label", F.col("__n.k")).drop("__n", "__c")


def resolve(redirects: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(image_id, label, target) with every target followed to the end, by pointer jumping: chains halve in each round."""
    now = cut(redirects)
    for _ in range(most_rounds):
        ahead = now.select("image_id", F.col("label").alias("target"), F.col("target").alias("__next"))
        stepped = now.join(ahead, ["image_id", "target"], "left").select("image_id", "label", F.coalesce("__next", "target").alias("target"), F.col("__next").isNotNull().alias("__moved"))
        if not stepped.filter("__moved").limit(1).count():
            return now
        now = cut(stepped.drop("__moved"))
    raise RuntimeError("the redirects hold a cycle")


def clear_backdrop(pixels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pixels with alpha 0 where a 4-connected area of candidates reaches the image's edge."""
    mask = pixels.join(candidates.select("image_id", "y", "x", F.lit(1).alias("label")), ["image_id", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    parts = components(mask.select("image_id", "y", "x", "label"))
    size = pixels.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    touching = parts.join(size, "image_id").filter("component > 0 AND (y = 0 OR x = 0 OR y = h OR x = w)").select("image_id", "component").distinct()
    gone = parts.join(touching, ["image_id", "component"], "left_semi").select("image_id", "y", "x", F.lit(True).alias("__gone"))
    return pixels.join(gone, ["image_id", "y", "x"], "left").withColumn("a", F.when(F.col("__gone"), 0).otherwise(F.col("a"))).drop("__gone")


def absorption_targets(stats: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "component") -> DataFrame:
    """For each part of gone (image_id, key) the neighbour that it would join: of those that stay if there is one, the closest in colour, then the lowest number."""
    colour = lambda p, n: stats.select("image_id", F.col(key).alias(n), *(F.col(f"mean_{c}").alias(f"{p}{c}") for c in "rgb"))
    leaving = gone.select("image_id", F.col(key).alias("other"), F.lit(True).alias("leaves"))
    met = symmetric(edges).join(gone.select("image_id", F.col(key).alias("node")), ["image_id", "node"]).join(colour("p", "node"), ["image_id", "node"]).join(colour("q", "other"), ["image_id", "other"]).join(leaving, ["image_id", "other"], "left")
    far = F.round(sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "rgb"), d(0)), 3)
    rank = F.struct(F.coalesce("leaves", F.lit(False)).alias("leaves"), far.alias("far"), F.col("other"))
    return met.groupBy("image_id", F.col("node").alias(key)).agg(F.min_by("other", rank).alias("target"))


def solid(parts: DataFrame, band: int, key: str = "component") -> DataFrame:
    """Each part with the pixels of its inside, farther than band from any other part, and whether they are enough to be a shape."""
    inside = interior(parts.withColumn("label", F.col(key)), band)
    count = inside.groupBy("image_id", key).agg(F.count("*").alias("inner"))
    every = parts.filter(F.col(key) > 0).select("image_id", key).distinct()
    return every.join(count, ["image_id", key], "left").withColumn("inner", F.coalesce("inner", F.lit(0))).withColumn("solid", F.col("inner") >= max(4, band * band))


def chain_shapes(parts: DataFrame, shapes: DataFrame, key: str = "label") -> DataFrame:
    """Each chain of pixels of parts that are no solid shapes, with the sorted shapes that it touches, and whether it is on the raster's rim."""
    own = parts.select("image_id", "y", "x", F.col(key).alias("part")).join(shapes.select("image_id", F.col(key).alias("part"), "solid"), ["image_id", "part"], "left")
    named = components(own.withColumn("label", (~F.coalesce("solid", F.lit(True))).cast("int")).select("image_id", "y", "x", "part", "label", "solid"))
    ahead = lambda c: F.array(*(f(c).over(w) for w in (along_row(), along_column()) for f in (F.lag, F.lead)))
    near = named.withColumn("beside", ahead(F.when(F.col("solid"), F.col("part")))).withColumn("sides", ahead(F.lit(1)))
    held = near.filter("component > 0")
    shape = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact("beside")))))
    return held.groupBy("image_id", F.col("component").alias("chain")).agg(shape.alias("shapes"), F.count("*").alias("pixels"), F.max(F.size(F.array_compact("sides")) < 4).alias("rim"))


def largest(stats: DataFrame, key: str = "component") -> DataFrame:
    """Each image's largest part, of equal ones the lowest, with its mean colour."""
    order = F.struct(F.col("area"), -F.col(key))
    return stats.groupBy("image_id").agg(F.max_by(F.struct(key, "mean_r", "mean_g", "mean_b"), order).alias("__p")).select("image_id", "__p.*")


def overlapping(stats: DataFrame, key: str = "component", margin: float = 0.5) -> DataFrame:
    """Pairs lo < hi of parts of an image whose bounds overlap, the one side grown by margin: an equi-join on the image, of parts, not of pixels."""
    box = lambda n: stats.select("image_id", F.struct(F.col(key).alias("part"), F.col("left").alias("x0"), F.col("right").alias("x1"), F.col("top").alias("y0"), F.col("bottom").alias("y1")).alias(n))
    met = box("a").join(box("b"), "image_id").filter((F.col("a.part") < F.col("b.part")) & boxes_overlap("a", "b", margin))
    return met.select("image_id", F.col("a.part").alias("lo"), F.col("b.part").alias("hi"))


def united(stats: DataFrame, pairs: DataFrame, key: str = "component") -> DataFrame:
    """Pairs (lo, hi) as one region: summed area, members, and the neighbours of either without the two."""
    side = lambda n: stats.select("image_id", F.col(key).alias(n), F.col("area").alias(f"{n}_area"), F.col("neighbours").alias(f"{n}_near"))
    met = pairs.join(side("lo"), ["image_id", "lo"]).join(side("hi"), ["image_id", "hi"])
    near = F.array_except(F.array_union("lo_near", "hi_near"), F.array("lo", "hi"))
    return met.select("image_id", "lo", "hi", (F.col("lo_area") + F.col("hi_area")).alias("area"), F.array_join(F.array_sort(near).cast("array<string>"), ",").alias("neighbours"))


def scattered(pixels: DataFrame, region_pixels: DataFrame) -> DataFrame:
    """region: the number of the region that a pixel belongs to, 0 outside of all."""
    return pixels.join(region_pixels.select("image_id", "y", "x", "region"), ["image_id", "y", "x"], "left").withColumn("region", F.coalesce("region", F.lit(0)))
