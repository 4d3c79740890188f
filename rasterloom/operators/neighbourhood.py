"""Two-dimensional neighbourhoods as two passes of row windows: one sort along the rows, one along the columns, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def with_block(pixels: DataFrame, value: Column, name: str = "block", border: str = "reflect") -> DataFrame:
    """name: the nine values around each pixel, row by row. border: reflect (the edge pixel again) or skip (null)."""
    edge = (lambda c, own: F.coalesce(c, own)) if border == "reflect" else (lambda c, own: c)
    v = F.col("__v")
    across = pixels.withColumn("__v", value).withColumn("__row", F.array(edge(F.lag(v).over(along_row()), v), v, edge(F.lead(v).over(along_row()), v)))
    r = F.col("__row")
    none = F.array(*[F.lit(None).cast("double")] * 3)
    side = lambda c: F.coalesce(c, r if border == "reflect" else none)
    return across.withColumn(name, F.concat(side(F.lag(r).over(along_column())), r, side(F.lead(r).over(along_column())))).drop("__v", "__row")


def median9(block: str = "block") -> Column:
    return F.element_at(F.sort_array(block), 5)


def spread9(block: str = "block") -> Column:
    return F.array_max(block) - F.array_min(block)


def sobel(block: str = "block") -> Column:
    """Gradient magnitude."""
    at = lambda i: F.element_at(block, i)
    two = F.lit(2.0)
    dx = at(3) + two * at(6) + at(9) - at(1) - two * at(4) - at(7)
    dy = at(7) + two * at(8) + at(9) - at(1) - two * at(2) - at(3)
    return F.sqrt(dx * dx + dy * dy)


def window_max(pixels: DataFrame, value: str, radius: int, name: str) -> DataFrame:
    """The maximum over a square window; the border only cuts it, which for a maximum is the same as reflecting."""
    across = pixels.withColumn("__m", F.max(value).over(along_row().rowsBetween(-radius, radius)))
    return across.withColumn(name, F.max("__m").over(along_column().rowsBetween(-radius, radius))).drop("__m")


def boundary(labels: DataFrame, label: str = "label") -> DataFrame:
    """on_boundary: a 4-neighbour has another label."""
    v = F.col(label)
    other = F.lit(False)
    for w in (along_row(), along_column()):
        for f in (F.lag, F.lead):
            other = other | F.coalesce(f(v).over(w) != v, F.lit(False))
    return labels.withColumn("on_boundary", other)


def dilate(mask: DataFrame, radius: int, grid: DataFrame) -> DataFrame:
    """The pixels of grid within Manhattan distance radius of mask (image_id, y, x): a cross grown radius times, clipped to grid."""
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if abs(dy) + abs(dx) <= radius]
    moved = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("s")
    grown = mask.select("image_id", "y", "x", moved).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    return grid.join(grown, ["image_id", "y", "x"], "left_semi")


def interior(labels: DataFrame, radius: int) -> DataFrame:
    """Pixels farther than radius, by Manhattan distance, from every boundary pixel."""
    edge = boundary(labels).filter("on_boundary").select("image_id", "y", "x")
    return labels.join(dilate(edge, radius, labels.select("image_id", "y", "x")), ["image_id", "y", "x"], "left_anti")


def distance_within(pixels: DataFrame, outside: str, radius: int) -> DataFrame:
    """distance: Euclidean distance to the nearest pixel where outside holds, if it is at most radius, else null. The ring of offsets is fixed, so nothing grows."""
    ring = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    moved = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(dy * dy + dx * dx) ** 0.5).alias("far")) for dy, dx in ring])).alias("s")
    reach = pixels.filter(outside).select("image_id", "y", "x", moved).groupBy("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).agg(F.min("s.far").alias("distance"))
    return pixels.join(reach, ["image_id", "y", "x"], "left")


def median_rgb(pixels: DataFrame) -> DataFrame:
    """Denoised pixels: the 3 x 3 median of each colour channel, all three in one pass; alpha stays."""
    middle = lambda c: F.element_at(F.sort_array(F.transform("__rgb", lambda v: v[c])), 5).alias(c)
    return with_block(pixels, F.struct("r", "g", "b"), "__rgb").select("image_id", "y", "x", *map(middle, "rgb"), "a")


def _ring(radius: int) -> Column:
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(dy * dy + dx * dx).alias("far")) for dy, dx in offsets])).alias("s")


def nearest_donor(pixels: DataFrame, takes: str, gives: str, radius: int) -> DataFrame:
    """Pixels where takes holds with the colour of the nearest pixel within radius where gives holds (of equal ones the first by row and column); without one, and all others, as they are.

    Givers reach out over a fixed ring, so nothing is compared with a whole image."""
    reach = pixels.filter(gives).select("image_id", "y", "x", F.struct("r", "g", "b").alias("rgb"), _ring(radius))
    best = reach.groupBy("image_id", (F.col("y") + F.col("s.dy")).alias("ty"), (F.col("x") + F.col("s.dx")).alias("tx")).agg(F.min_by("rgb", F.struct("s.far", "y", "x")).alias("given"))
    met = pixels.join(best.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "given"), ["image_id", "y", "x"], "left")
    taken = F.expr(takes) & F.col("given").isNotNull()
    return met.select("image_id", "y", "x", *(F.when(taken, F.col(f"given.{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"), "a")


def repair_colors(pixels: DataFrame, radius: int = 2) -> DataFrame:
    """Soft pixels near the outside (alpha below 0.02) with the colour of the nearest pixel that is kept: alpha of 0.9, or farther than radius from the outside. As they are in images without an outside."""
    far = distance_within(pixels, "a < 5.1", radius)
    kept = (F.col("a") >= 229.5) | ((F.col("a") >= 5.1) & F.col("distance").isNull())
    return nearest_donor(far.withColumn("kept", kept), "NOT kept", "kept", 2 * radius + 1)


def coverage(pixels: DataFrame, radius: int = 2, floor: float = 0.25) -> DataFrame:
    """coverage: alpha, raised by the distance to the outside where no pixel of the window is nearly opaque and alpha reaches floor."""
    around = window_max(pixels, "a", radius, "__most")
    far = distance_within(around, "a < 5.1", radius)
    alpha = F.col("a") / F.lit(255.0)
    raised = alpha + (F.lit(1.0) - alpha) * F.least(F.lit(1.0), F.coalesce(F.col("distance"), F.lit(float(radius))) / F.lit(float(radius)))
    return far.withColumn("coverage", F.when((alpha >= F.lit(floor)) & (F.col("__most") < 229.5), raised).otherwise(alpha)).drop("__most", "distance")


def band_average(band: DataFrame, value: str, radius: int) -> DataFrame:
    """average: mean of value over the band's own pixels in a square about each: two passes of row sums and counts, of which gaps take no part."""
    near = lambda axis, other: Window.partitionBy("image_id", other).orderBy(axis).rangeBetween(-radius, radius)
    if radius < 1:
        return band.withColumn("average", F.col(value).cast("double"))
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("step")
    # a row's sum is wanted at places of other rows too, so pixels are first sent up and down their column
    sent = band.select("image_id", "y", "x", F.col(value).cast("double").alias("v"), steps).select("image_id", (F.col("y") + F.col("step")).alias("y"), "x", "v")
    columns = sent.groupBy("image_id", "y", "x").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    summed = columns.withColumns({"v": F.sum("v").over(near("x", "y")), "n": F.sum("n").over(near("x", "y"))})
    return band.join(summed, ["image_id", "y", "x"]).withColumn("average", F.col("v") / F.col("n")).drop("v", "n")
