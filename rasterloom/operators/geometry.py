"""Closed polylines (key columns, seq, x, y) and cubic segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import d


def _cyclic(points: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """n, and the neighbours reach before and after as px, py, nx, ny, going round."""
    order = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(whole)
    wrapped = points.withColumn("n", n)
    for name, c in (("x", "x"), ("y", "y")):
        ends = F.collect_list(c).over(whole)
        wrapped = wrapped.withColumn(f"p{name}", F.coalesce(F.lag(c, reach).over(order), F.element_at(ends, F.row_number().over(order) - reach - 1)))
        wrapped = wrapped.withColumn(f"n{name}", F.coalesce(F.lead(c, reach).over(order), F.get(ends, F.row_number().over(order) - 1 + reach - n.cast("int"))))
    return wrapped


def area(points: DataFrame, keys: list[str]) -> DataFrame:
    """Shoelace area of each polyline."""
    return _cyclic(points, keys).groupBy(*keys).agg(F.round(F.abs(F.sum(F.col("x") * F.col("ny") - F.col("y") * F.col("nx"))) / d(2), 6).alias("area"))


def smooth(points: DataFrame, keys: list[str], passes: int = 1) -> DataFrame:
    """Weights 1/4, 1/2, 1/4 going round, passes times; polylines of under five points stay."""
    for _ in range(passes):
        moved = _cyclic(points, keys)
        part = lambda c: F.when(F.col("n") >= 5, F.col(f"p{c}") * d(0.25) + F.col(c) * d(0.5) + F.col(f"n{c}") * d(0.25)).otherwise(F.col(c))  # noqa: E731,B023
        points = moved.select(*keys, "seq", part("x").alias("x"), part("y").alias("y"))
    return points


def turns(points: DataFrame, keys: list[str], span: int) -> DataFrame:
    """turn: angle in degrees between the way in over span points and the way out."""
    t = _cyclic(points, keys, span)
    ux, uy, vx, vy = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cos = F.greatest(d(-1), F.least(d(1), F.try_divide(ux * vx + uy * vy, F.nullif(size, d(0)))))
    return t.select(*keys, "seq", F.round(F.coalesce(F.degrees(F.acos(cos)), d(0)), 6).alias("turn"))


def drop_repeats(points: DataFrame, keys: list[str], epsilon: float = 1e-9) -> DataFrame:
    """Without points that repeat the one before."""
    order = Window.partitionBy(*keys).orderBy("seq")
    same = (F.abs(F.col("x") - F.lag("x").over(order)) <= d(epsilon)) & (F.abs(F.col("y") - F.lag("y").over(order)) <= d(epsilon))
    return points.withColumn("__same", F.coalesce(same, F.lit(False))).filter("NOT __same").drop("__same")


def chords(points: DataFrame, keys: list[str]) -> DataFrame:
    """t: length along the polyline over its whole length; even steps where it has none."""
    order = Window.partitionBy(*keys).orderBy("seq")
    step = points.withColumn("__s", F.coalesce(F.sqrt((F.col("x") - F.lag("x").over(order)) * (F.col("x") - F.lag("x").over(order)) + (F.col("y") - F.lag("y").over(order)) * (F.col("y") - F.lag("y").over(order))), d(0)))
    every = Window.partitionBy(*keys)
    even = F.try_divide(F.row_number().over(order) - d(1), F.nullif(F.count("*").over(every) - d(1), d(0)))
    along = F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return step.select(*keys, "seq", F.round(F.coalesce(F.try_divide(along, F.nullif(F.sum("__s").over(every), d(0))), even, d(0)), 6).alias("t"))


def bezier(control: list[Column], t: Column) -> Column:
    """One coordinate of a cubic at t."""
    u = d(1) - t
    return u * u * u * control[0] + d(3) * u * u * t * control[1] + d(3) * u * t * t * control[2] + t * t * t * control[3]


def boxes_overlap(a: str, b: str, margin: float = 0.5) -> Column:
    at = lambda n, k: F.col(f"{n}.{k}")
    m = d(margin)
    return (at(a, "x0") < at(b, "x1") + m) & (at(b, "x0") < at(a, "x1") + m) & (at(a, "y0") < at(b, "y1") + m) & (at(b, "y0") < at(a, "y1") + m)


def kept_contours(points: DataFrame, keys: list[str], least_points: int = 8, least_area: float = 0.6) -> DataFrame:
    """Rings of enough points and area, with both."""
    counted = points.groupBy(*keys).agg(F.count("*").alias("points")).filter(F.col("points") >= least_points)
    return counted.join(area(points, keys), keys).filter(F.col("area") >= d(least_area))


def end_tangent(points: DataFrame, keys: list[str], reach: int = 4) -> DataFrame:
    """Unit direction in which each polyline sets out: the deltas from its first point to the next ones, weighted by one over their number; (0, 0) where they cancel out."""
    place = points.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1).filter(F.col("k") <= reach)
    first = place.groupBy(*keys).agg(F.max(F.when(F.col("k") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("k") == 0, F.col("y"))).alias("y0"))
    late = place.filter("k > 0").join(first, keys)
    sums = late.groupBy(*keys).agg(F.sum((F.col("x") - F.col("x0")) / F.col("k")).alias("dx"), F.sum((F.col("y") - F.col("y0")) / F.col("k")).alias("dy"))
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    part = lambda c: F.round(F.when(size > d(1e-12), F.col(c) / size).otherwise(d(0)), 6) + d(0)
    return sums.select(*keys, part("dx").alias("tx"), part("dy").alias("ty"))


def bezier_normal(points: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Per polyline the sums of the normal equations of a cubic between its ends with end directions along x and y: what a least-squares fit solves."""
    u = d(1) - F.col(t)
    b1, b2 = d(3) * u * u * F.col(t), d(3) * u * F.col(t) * F.col(t)
    return points.groupBy(*keys).agg(F.round(F.sum(b1 * b1), 6).alias("c11"), F.round(F.sum(b1 * b2), 6).alias("c12"), F.round(F.sum(b2 * b2), 6).alias("c22"), F.round(F.sum(b1 * F.col("x")), 5).alias("x1"), F.round(F.sum(b2 * F.col("y")), 5).alias("y2"))


def worst(points: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """The largest error of each polyline and the first place where it stands."""
    return points.groupBy(*keys).agg(F.max(error).alias("error"), F.min_by("seq", F.struct(-F.col(error), F.col("seq"))).alias("at"))


def newton(control_x: list[Column], control_y: list[Column], x: Column, y: Column, t: Column) -> Column:
    """One Newton step of the parameter of the point (x, y) towards its foot on a cubic, within 0 and 1."""
    u = d(1) - t

    def parts(c: list[Column]) -> tuple[Column, Column, Column]:
        first = d(3) * (u * u * (c[1] - c[0]) + d(2) * u * t * (c[2] - c[1]) + t * t * (c[3] - c[2]))
        second = d(6) * (u * (c[2] - d(2) * c[1] + c[0]) + t * (c[3] - d(2) * c[2] + c[1]))
        return bezier(c, t), first, second

    (px, dx, ex), (py, dy, ey) = parts(control_x), parts(control_y)
    slope = dx * dx + dy * dy + (px - x) * ex + (py - y) * ey
    step = F.when(F.abs(slope) > d(1e-12), ((px - x) * dx + (py - y) * dy) / slope).otherwise(d(0))
    return F.least(d(1), F.greatest(d(0), t - step))
