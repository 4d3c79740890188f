"""Rows computed once and kept where no lost executor loses them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df from the checkpoint folder: the one in spark.checkpoint.dir, or where that is unset, as in tests, one of the session's own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rasterloom-checkpoints-"))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df, which must be cheap to count, marked for broadcast only if it has at most most_rows rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
