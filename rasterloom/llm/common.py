"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the five ASCII line and tab controls.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column | str) -> Column:
    """Words of a text as a long; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def unit_hash(seed: int, *cols: Column) -> Column:
    """A double in [0, 1) that depends on the seed and the columns alone; nulls count as the word null."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def ensure_checkpoints(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir is the session's own choice; one is set here only where there is none, as in tests."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rasterloom-checkpoints-"))


#: Rows that a partition of a cut holds where their number is known to be few: of some numbers each, of arrays, and of whole texts.
CUT_ROWS, CUT_WIDE_ROWS, CUT_TEXTS = 100_000, 20_000, 5_000


def cut(df: DataFrame, most_rows: int | None = None, each: int = CUT_ROWS) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so that no lost executor loses them.

    most_rows, a bound on the number of rows if one is known, keeps few rows from being spread over very many files.
    """
    ensure_checkpoints(df.sparkSession)
    if most_rows is not None:
        df = df.coalesce(most_rows // each + 1)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, which must be cheap to count, marked for broadcast only if it has at most most_rows rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def crc_bucket(column: str, parts: int) -> Column:
    """crc32 of a column as text, modulo parts; null where the column is null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share."""
    ensure_checkpoints(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def span(text: str, chars: int) -> Column:
    """The text, or of a longer one its first and its last chars / 2 characters with a space between."""
    return F.when(F.length(text) <= chars, F.col(text)).otherwise(F.concat(F.substring(text, 1, chars // 2), F.lit(" "), F.substring(text, -(chars // 2), chars // 2)))


def hash_sample(df: DataFrame, most: int, *columns: str, seed: int = 0, of: DataFrame | None = None) -> DataFrame:
    """At most most rows of df, those of least hash of the columns.

    Rows are thinned by the hash before the order is taken, at three times the share needed of all rows (of, where counting df itself
    would read texts), so that what tasks send to the driver does not grow with their number.
    """
    n = (df if of is None else of).count()
    h = F.xxhash64(*(F.col(c) for c in columns), F.lit(seed))
    if n > 3 * most:
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 3 * most / n))
    return df.withColumn("__h", h).orderBy(F.pmod("__h", F.lit(1 << 40)), *columns).limit(most).drop("__h")
