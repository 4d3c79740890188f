"""Documents drawn again and compared with the pixels they came from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fill import render
from ..functions.lineage import cut
from ..operators import neighbourhood, score
from ..operators.pixels import d, flattened

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"


def draw(documents: DataFrame) -> DataFrame:
    """PIXELS of documents (image_id, width, height, svg). One that is null or cannot be drawn gives no pixels."""

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    grid = render(row.svg, int(row.width), int(row.height)).astype(np.int32)
                except ValueError:
                    continue
                y, x = np.indices(grid.shape[:2], np.int32).reshape(2, -1)
                yield pd.DataFrame({"image_id": row.image_id, "y": y, "x": x} | {c: grid[..., k].ravel() for k, c in enumerate("rgba")})

    whole = documents.filter("svg IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    return whole.select("image_id", "width", "height", "svg").mapInPandas(drawn, PIXELS)


def _edges(pixels: DataFrame, name: str) -> DataFrame:
    grey = (flattened("r") + flattened("g") + flattened("b")) / d(3)
    return neighbourhood.with_block(pixels, grey).select("image_id", "y", "x", neighbourhood.sobel().alias(name))


def scores(pixels: DataFrame, documents: DataFrame) -> DataFrame:
    """(image_id, similarity, edges) to four places: structural similarity, and the correlation of edge strengths over a grey ground. Null where there is nothing to compare."""
    again = cut(draw(documents))
    alike = score.ssim(pixels, again)
    met = _edges(pixels, "was").join(_edges(again, "now"), ["image_id", "y", "x"])
    edges = met.groupBy("image_id").agg(F.round(F.corr("was", "now"), 4).alias("edges"))
    return alike.join(edges, "image_id", "left").select("image_id", F.round("ssim", 4).alias("similarity"), F.nanvl("edges", F.lit(None)).alias("edges"))
