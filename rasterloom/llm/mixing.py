"""Mixing sources to target weights, in DataFrame operations only.

Tokens are added up per source, the targets follow from the weights by water-filling under a ceiling on repetition,
and each document is emitted floor(rate) times plus one more time with the probability of the fraction, decided by a
hash of its id and a seed.

Defined cases: a null text has size 0; a null source is a source of its own, the last in order; a source of size 0 has
target 0 and rate 0; documents with equal ids share one draw; an empty table gives an empty mix. Columns besides the
named ones pass through ``mix`` and are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, count_words, cut, unit_hash

MAX_REPEATS = 3
SEED = 20_240_601


def source_targets(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = MAX_REPEATS, text: str = "text", source: str = "source") -> DataFrame:
    """source, source_size, target and rate, a row per source.

    The weights repeat over the sources in code point order, null last. A source whose share exceeds max_repeats times
    its size stops there, and the excess goes to the others by weight. In order of ceiling over weight, a source is at
    its ceiling if its weight's share of what is left reaches that far, so one ordered pass over the sources settles
    all rounds. The windows hold one row per source, after aggregation.
    """
    sizes = docs.select(F.col(source).alias("source"), count_words(text).alias("size")).groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(pattern, F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * max_repeats)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))).alias("left_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
        F.sum("source_size").over(every).alias("whole"),
    ).withColumn("full", F.col("ceiling") * F.col("left_weight") <= F.col("weight") * F.col("left_size"))
    level = F.try_divide(
        F.col("whole") - F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(every), F.lit(0.0)),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(every),
    )
    shared = filled.withColumn("target", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("weight") * level))
    return shared.select("source", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))


def with_copies(docs: DataFrame, targets: DataFrame, seed: int = SEED, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The struct row (all columns of docs) and the struct mix (source_size, target, copies). The targets travel to the documents, never the other way, if they are few."""
    few = targets.select("source", F.struct("source_size", "target", "rate").alias("mix"))
    whole = F.floor("mix.rate")
    copies = whole + F.when(unit_hash(seed, F.col("id")) < F.col("mix.rate") - whole, 1).otherwise(0)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("of"))
    joined = rows.join(broadcast_if_small(few), F.col("of").eqNullSafe(F.col("source")), "left")
    return joined.select("row", F.struct("mix.source_size", "mix.target", copies.cast("long").alias("copies")).alias("mix"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = MAX_REPEATS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed collection: every column of docs, each document as often as the mix takes it."""
    targets = cut(source_targets(docs, weights, max_repeats, text, source))
    drawn = with_copies(docs, targets, seed, doc_id, source).filter("mix.copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    targets = cut(source_targets(docs, weights, max_repeats))
    sized = docs.select("doc_id", "source", count_words("text").alias("size"))
    return with_copies(sized, targets, seed).select("row.doc_id", "row.size", "mix.source_size", "mix.target", (F.col("row.size") * F.col("mix.copies")).alias("taken"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * {MAX_REPEATS} AS ceiling FROM s
), f AS (
  SELECT *, sum(source_size) OVER () AS whole,
    sum(source_size) OVER () - COALESCE(sum(ceiling) OVER b, 0) AS left_size,
    sum(weight) OVER () - COALESCE(sum(weight) OVER b, 0) AS left_weight
  FROM r WINDOW b AS (ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, ceiling * left_weight <= weight * left_size AS is_full FROM f
), l AS (
  SELECT *, (whole - COALESCE(sum(CASE WHEN is_full THEN ceiling END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () AS level FROM g
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN is_full THEN ceiling ELSE weight * level END AS target,
    CASE WHEN source_size > 0 THEN (CASE WHEN is_full THEN ceiling ELSE weight * level END) / source_size ELSE 0 END AS rate
  FROM l
), u AS (
  SELECT d.*, t.source_size, t.target, t.rate,
    CAST(('0x' || substr(md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u
"""
