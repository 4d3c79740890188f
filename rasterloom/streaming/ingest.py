"""Incremental batches: new image files are traced once, and a log says with what options."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import settings
from ..plans.trace import trace
from ..sources.rasters import images, pixels

FILES = "path string, modificationTime timestamp, length long, content binary"


def trace_new_files(spark: SparkSession, folder: str, log: str, checkpoint: str, preset: str = "icon", quality: str = "balanced"):
    """A query that traces the files that came into folder since it last ran, appends a row for each to the Parquet log, and ends.

    The stream's own checkpoint knows which files it has seen; a batch that was begun and lost is done again.
    """
    options = json.dumps(settings(preset, quality), sort_keys=True)
    listed = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(folder).select("path")

    def batch(paths: DataFrame, number: int) -> None:
        names = [r.path for r in paths.distinct().collect()]  # bounded by maxFilesPerTrigger
        if not names:
            return
        read = images(paths.sparkSession, names).withColumn("image_id", F.xxhash64("path"))
        done = trace(pixels(read), preset, quality)
        rows = read.select("image_id", "path", F.col("error").alias("unread")).join(done, "image_id", "left")
        rows.select("path", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("error", "unread").alias("error"), "regions", "svg", F.lit(options).alias("options"), F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(log)

    return listed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs begun within carry the tag, by which cancel ends them from elsewhere."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str, *queries) -> None:
    """Ends all jobs of the tag, and streaming queries so that what they have not begun stays undone."""
    for query in queries:
        query.stop()
    spark.sparkContext.cancelJobsWithTag(tag)
