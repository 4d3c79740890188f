"""How alike two rasters are, image by image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbourhood import along_column, along_row
from .pixels import d, premultiplied

SIDE = 7
#: Fixed values of the structural similarity: shares of the range of levels, 255.
K1, K2 = 0.01, 0.03
_AREA = float(SIDE * SIDE)


def ssim(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, ssim): the mean structural similarity over all whole 7 x 7 windows and the three premultiplied channels.

    The sums of a window come from two passes of row windows. An image with a side below 7 gets null, as does one that
    only one of a and b has; both must have the same size.
    """
    half = SIDE // 2
    of = lambda df, n: df.select("image_id", "y", "x", *(premultiplied(c).alias(f"{c}{n}") for c in "rgb"))
    both = of(a, 1).join(of(b, 2), ["image_id", "y", "x"])
    parts = {}
    for c in "rgb":
        p, q = F.col(f"{c}1"), F.col(f"{c}2")
        parts |= {f"{c}p": p, f"{c}q": q, f"{c}pp": p * p, f"{c}qq": q * q, f"{c}pq": p * q}
    across, down = (w().rowsBetween(-half, half) for w in (along_row, along_column))
    wide = both.select("image_id", "y", "x", *(F.sum(v).over(across).alias(n) for n, v in parts.items()), F.count(F.lit(1)).over(across).alias("nx"))
    sums = wide.filter(F.col("nx") == SIDE).select("image_id", *(F.sum(n).over(down).alias(n) for n in parts), F.count(F.lit(1)).over(down).alias("ny")).filter(F.col("ny") == SIDE)
    c1, c2, unbiased = d((K1 * 255) ** 2), d((K2 * 255) ** 2), d(_AREA / (_AREA - 1))

    def alike(c: str):
        mp, mq, mpp, mqq, mpq = (F.col(f"{c}{k}") / d(_AREA) for k in ("p", "q", "pp", "qq", "pq"))
        vp, vq, vpq = unbiased * (mpp - mp * mp), unbiased * (mqq - mq * mq), unbiased * (mpq - mp * mq)
        return (d(2) * mp * mq + c1) * (d(2) * vpq + c2) / ((mp * mp + mq * mq + c1) * (vp + vq + c2))

    means = sums.groupBy("image_id").agg(F.avg((alike("r") + alike("g") + alike("b")) / d(3)).alias("ssim"))
    known = a.select("image_id").distinct().join(b.select("image_id").distinct(), "image_id", "full")
    return known.join(means, "image_id", "left")
