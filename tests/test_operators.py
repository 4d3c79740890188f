"""Properties of the raster operators that SQL does not show."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.kernels import label4
from rasterloom.operators import analysis, batch, regions, resample, score, text
from rasterloom.sources import rasters


def png(path, rgba: np.ndarray):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, n = rgba.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgba.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_pixels_and_a_corrupt_file(spark, tmp_path):
    rgba = np.random.default_rng(0).integers(0, 256, (4, 5, 4))
    png(tmp_path / "good.png", rgba)
    (tmp_path / "bad.png").write_bytes(b"not an image")
    read = rasters.images(spark, str(tmp_path)).withColumn("image_id", F.lit(1))
    assert {r.error for r in read.collect()} == {None, "undecodable"}
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in rasters.pixels(read).collect()}
    assert got == {(y, x): tuple(int(v) for v in rgba[y, x]) for y in range(4) for x in range(5)}


def test_kinds_of_drawn_images(spark):
    kinds = {r.image_id: r.kind for r in analysis.analyze(rasters.procedural(spark, 64)).collect()}
    assert kinds[1] == "icon" and kinds[3] == "photo"


def test_label4_against_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        grid = rng.integers(0, 3, (9, 11))
        want, n = np.zeros_like(grid), 0
        for y in range(9):
            for x in range(11):
                if grid[y, x] and not want[y, x]:
                    n += 1
                    stack = [(y, x)]
                    while stack:
                        a, b = stack.pop()
                        if 0 <= a < 9 and 0 <= b < 11 and grid[a, b] == grid[y, x] and not want[a, b]:
                            want[a, b] = n
                            stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert (label4(grid) == want).all()


def test_backdrop_clears_what_touches_the_edge_only(spark):
    art = rasters.procedural(spark, 32).filter("image_id = 1")
    cleared = regions.clear_backdrop(art, art.filter("r = 250"))
    assert cleared.filter("a = 0").count() == art.filter("r = 250").count()
    assert regions.clear_backdrop(art, art.filter("r = 200")).filter("a = 0").count() == 0


def test_settings():
    assert batch.settings("photo", "fast")["supersample"] == 2
    assert batch.settings("icon", "max", {"init_clusters": 9, "denoise": None})["init_clusters"] == 9
    with pytest.raises(ValueError, match="preset"):
        batch.settings("none")
    with pytest.raises(ValueError, match="quality"):
        batch.settings("icon", "none")


def test_texts(spark):
    rows = spark.createDataFrame([(0.5, 900.0, "/a/b.png"), (-0.04, 2048.0, "c"), (12.0, 3e6, "x.y/z.jpg")], "v double, n double, p string")
    got = rows.select(text.path_number(F.col("v")), text.attribute_number(F.col("v")), text.human_bytes(F.col("n")), text.destination(F.col("p"), "out")).collect()
    assert [r[0] for r in got] == [".5", "0", "12"]
    assert [r[1] for r in got] == ["0.5", "-0.04", "12"]
    assert [r[2][-2:] for r in got] == [" B", "KB", "MB"]
    assert [r[3] for r in got] == ["out/b.svg", "out/c.svg", "out/z.svg"]
    joined = spark.range(1).select(text.join_numbers(F.array(F.lit("1"), F.lit("-2"), F.lit(".5"), F.lit(".5")))).first()[0]
    assert joined == "1-2 .5.5"


def test_resampling_keeps_flat_images_and_small_ones(spark):
    flat = spark.range(40).select(F.lit(1).alias("image_id"), F.expr("cast(id div 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("x"), F.lit(200).alias("r"), F.lit(7).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    for method in ("nearest", "bilinear", "bicubic", "lanczos", "unknown"):
        small, large = resample.cap_size(flat, 4, method).collect(), resample.supersample(flat, 3, method).collect()
        assert len(small) == 4 * 2 and len(large) == 24 * 15  # 2.5 rows round to the even 2
        assert {(r.r, r.g, r.b, r.a) for r in small + large} == {(200, 7, 0, 255)}
    assert sorted(resample.cap_size(flat, 8).collect()) == sorted(flat.collect()) == sorted(resample.supersample(flat, 1).collect())
    assert resample.cap_size(flat.limit(0), 4).count() == 0


def test_nearest_supersampling_repeats_pixels(spark):
    grid = spark.range(12).select(F.lit(1).alias("image_id"), F.expr("cast(id div 4 as int)").alias("y"), F.expr("cast(id % 4 as int)").alias("x"), *(F.col("id").cast("int").alias(c) for c in "rgb"), F.lit(255).alias("a"))
    assert all(r.r == 4 * (r.y // 2) + r.x // 2 for r in resample.supersample(grid, 2, "nearest").collect())


def test_a_raster_is_wholly_like_itself(spark):
    drawn = rasters.procedural(spark, 16)
    assert {round(r.ssim, 9) for r in score.ssim(drawn, drawn).collect()} == {1.0}
    other = score.ssim(drawn, drawn.withColumn("r", 255 - F.col("r"))).collect()
    assert all(r.ssim < 1 for r in other)
    assert {r.ssim for r in score.ssim(drawn.filter("x < 6"), drawn.filter("x < 6")).collect()} == {None}
