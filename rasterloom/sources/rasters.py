"""Rasters as a relation image_id, y, x, r, g, b, a."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of files that are taken for images.
SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff", "ppm", "pgm", "tga", "ico", "jfif", "avif", "heic", "heif")
MOST_PIXELS = 256_000_000
ROWS_PER_IMAGE, WIDTH = 50, 64


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """A raster for every 50 vectors: a vector is a row of pixels; green and blue are the same values turned by 21 and 42 places."""
    level = lambda i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.element_at("embedding", i.cast("int")).cast("double") + F.lit(0.5)) * 255))).cast("int")
    x = F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x")
    laid = embeddings.filter(F.size("embedding") == WIDTH).select("vec_id", "embedding", x)
    y = (F.col("vec_id") % ROWS_PER_IMAGE).cast("int")
    turned = lambda k: level((F.col("x") + k) % WIDTH + 1)
    return laid.select(F.expr(f"vec_id div {ROWS_PER_IMAGE}").alias("image_id"), y.alias("y"), "x", turned(0).alias("r"), turned(21).alias("g"), turned(42).alias("b"), F.when((F.col("x") + y) % 11 == 0, 40).otherwise(255).alias("a"))


def procedural(spark: SparkSession, size: int = 64) -> DataFrame:
    """Four drawn images: a disc with a radial ramp on nothing, two flat rectangles, a two-way ramp, and a fine checker."""
    base = spark.range(4 * size * size).select(F.expr(f"id div {size * size}").alias("image_id"), F.expr(f"cast((id div {size}) % {size} as int)").alias("y"), F.expr(f"cast(id % {size} as int)").alias("x"))
    cx = (F.col("x") - size / 2) ** 2 + (F.col("y") - size / 2) ** 2
    inside = (F.col("x") > size // 4) & (F.col("x") < 3 * size // 4) & (F.col("y") > size // 4) & (F.col("y") < size // 2)
    pick = lambda a, b, c, d: F.element_at(F.array(*(v.cast("int") if hasattr(v, "cast") else F.lit(v) for v in (a, b, c, d))), (F.col("image_id") + 1).cast("int"))
    checker = F.when((F.col("x") + F.col("y")) % 2 == 0, 230).otherwise(20)
    ramp = lambda c: F.floor(F.col(c) * 255 / (size - 1))
    return base.select("image_id", "y", "x", pick(F.floor(F.sqrt(cx) * 4) % 256, F.when(inside, 200).otherwise(250), ramp("x"), checker).alias("r"), pick(60, F.when(inside, 30).otherwise(250), ramp("y"), checker).alias("g"), pick(180, F.when(inside, 30).otherwise(250), 180, checker).alias("b"), pick(F.when(cx < (size * 0.45) ** 2, 255).otherwise(0), 255, 255, 255).alias("a"))


#: Name, width, height and preset of the drawn images that traces are timed and scored on.
DRAWN = (("poster", 900, 600, "icon"), ("flat-shapes", 640, 640, "icon"), ("shaded-orb", 520, 520, "icon"), ("hairlines", 560, 560, "photo"), ("texture", 480, 480, "photo"), ("alpha-cutout", 480, 480, "icon"))
#: What the drawn images hold, by x, y, w, h and by u and v, the same from 0 to 1: the colour 65536 r + 256 g + b, or null for nothing.
DRAWINGS = (
    "CASE WHEN floor(v * 12e0) % 2 = 1 AND floor(u * (20e0 + floor(v * 12e0) * 3e0)) % 3 <> 0 AND v * 12e0 - floor(v * 12e0) BETWEEN 2e-1 AND 8e-1 THEN 1973820 ELSE 16117990 END",
    "CASE WHEN u > 15e-2 AND u < 45e-2 AND v > 15e-2 AND v < 4e-1 THEN 13117480 WHEN sqrt((u - 7e-1) * (u - 7e-1) + (v - 3e-1) * (v - 3e-1)) BETWEEN 1e-1 AND 2e-1 THEN 1989320 WHEN v > 7e-1 AND v < 9e-1 AND floor(u * 40e0) % 4 = 0 THEN 1315860 ELSE 16448250 END",
    "CASE WHEN sqrt((u - 5e-1) * (u - 5e-1) + (v - 5e-1) * (v - 5e-1)) < 4e-1 THEN floor(255e0 - 200e0 * sqrt((u - 4e-1) * (u - 4e-1) + (v - 38e-2) * (v - 38e-2)) / 6e-1) * 65536 + floor(230e0 - 150e0 * sqrt((u - 4e-1) * (u - 4e-1) + (v - 38e-2) * (v - 38e-2)) / 6e-1) * 256 + floor(210e0 - 60e0 * sqrt((u - 4e-1) * (u - 4e-1) + (v - 38e-2) * (v - 38e-2)) / 6e-1) ELSE 15462130 END",
    "CASE WHEN abs(sqrt((u - 5e-1) * (u - 5e-1) + (v - 5e-1) * (v - 5e-1)) - 35e-2) * w < 15e-1 THEN 13107200 WHEN x % 56 = 0 OR y % 80 < 2 THEN 0 ELSE 16777215 END",
    "(floor((60e0 + abs((x * 6) % w * 2e0 - w) / w * 120e0 + (x * 7919 + y * 104729 + x * y * 31) % 61) * CASE WHEN u > 35e-2 AND u < 6e-1 AND v > 35e-2 AND v < 6e-1 THEN 3e-1 ELSE 1e0 END)) * 65793",
    "CASE WHEN (u - 3e-1) * (u - 3e-1) / 484e-4 + (v - 35e-2) * (v - 35e-2) / 225e-4 < 1 THEN 15104020 WHEN sqrt((u - 7e-1) * (u - 7e-1) + (v - 35e-2) * (v - 35e-2)) < 18e-2 THEN 1349210 WHEN v > 6e-1 AND v < 95e-2 AND abs(u - 5e-1) < (v - 6e-1) * 8e-1 THEN 5913760 END",
)


def drawn(spark: SparkSession, shrink: int = 1) -> DataFrame:
    """Pixels of the drawn images, shrink times smaller."""
    out = None
    for k, ((_, width, height, _), drawing) in enumerate(zip(DRAWN, DRAWINGS, strict=True)):
        w, h = width // shrink, height // shrink
        places = spark.range(w * h).selectExpr(f"cast({k} as bigint) AS image_id", f"cast(id div {w} as int) AS y", f"cast(id % {w} as int) AS x", f"cast({w} as double) AS w", f"cast({h} as double) AS h")
        colour = places.selectExpr("*", "cast(x as double) / w AS u", "cast(y as double) / h AS v").selectExpr("image_id", "y", "x", f"cast({drawing} as int) AS c")
        part = colour.selectExpr("image_id", "y", "x", "coalesce(c div 65536, 0) AS r", "coalesce(c div 256 % 256, 0) AS g", "coalesce(c % 256, 0) AS b", "CASE WHEN c IS NULL THEN 0 ELSE 255 END AS a")
        part = part.selectExpr("image_id", "y", "x", *(f"cast({c} as int) AS {c}" for c in "rgba"))
        out = part if out is None else out.unionByName(part)
    return out


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, suffix, length and content of the files with an image suffix below a folder, each resolved path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*SUFFIXES)).dropDuplicates(["path"]).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, data and error of every image file; a file that cannot be decoded is a row with an error."""
    read = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path).select("image.*")
    bad = F.when(F.col("width") < 0, "undecodable").when(F.col("width").cast("long") * F.col("height") > MOST_PIXELS, "too large")
    return read.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data", bad.alias("error"))


def _exif_orientation(data: bytes) -> int:
    """The orientation tag of a JPEG file's first Exif segment; 1 where there is none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0" and len(body) > 14:
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            first = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[first : first + 2], order)):
                entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 274:
                    value = int.from_bytes(entry[8:10], order)
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def _has_alpha(data: bytes) -> bool:
    """Whether a PNG file has an alpha channel or a transparency entry before its pixels, or a GIF file a transparent colour."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        if data[25:26] in (b"\x04", b"\x06"):
            return True
        at = 8
        while at + 8 <= len(data) and data[at + 4 : at + 8] not in (b"IDAT", b"IEND"):
            if data[at + 4 : at + 8] == b"tRNS":
                return True
            at += 12 + int.from_bytes(data[at : at + 4], "big")
    elif data[:4] == b"GIF8":
        at = data.find(b"\x21\xf9\x04")
        return at >= 0 and bool(data[at + 3] & 1)
    return False


def provenance(files: DataFrame) -> DataFrame:
    """path, orientation and had_alpha of files (path, content), from their headers, which the decoder does not hand on."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [c.as_buffer().to_pybytes() if c.is_valid else b"" for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_exif_orientation(b) for b in heads], pa.int32()), pa.array([_has_alpha(b) for b in heads])], ["path", "orientation", "had_alpha"])

    return files.select("path", F.substring("content", 1, 1 << 20).alias("content")).mapInArrow(told, "path string, orientation int, had_alpha boolean")


def pixels(images: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Pixels of decoded images (with an image_id): the decoder's BGR or BGRA bytes as straight RGBA; grey images have one channel. An image's bytes are laid out by NumPy, block pixels at a time."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, width, channels, data in zip(*batch.columns, strict=True):
                w, c = width.as_py(), channels.as_py()
                grid = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, c)
                for at in range(0, len(grid), block):
                    part = grid[at : at + block].astype(np.int32)
                    place = np.arange(at, at + len(part), dtype=np.int32)
                    rgb = [part[:, k] for k in ((2, 1, 0) if c >= 3 else (0, 0, 0))]
                    alpha = part[:, 3] if c == 4 else np.full(len(part), 255, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([image.as_py()] * len(part), kind), *map(pa.array, (place // w, place % w, *rgb, alpha))], ["image_id", "y", "x", *"rgba"])

    whole = images.filter("error IS NULL AND width > 0 AND height > 0").select("image_id", "width", "channels", "data")
    name = whole.schema["image_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    return whole.mapInArrow(laid, f"image_id {name}, y int, x int, r int, g int, b int, a int")
