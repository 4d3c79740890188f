"""Settings, batches, reports and incremental runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pixels import d

#: Settings that every preset starts from.
BASE = {
    "supersample": 4, "resample": "lanczos", "aa_radius": 2.0, "alpha_floor": 0.25, "init_clusters": 40, "min_region_px": 8, "min_clusters": 10, "max_initial_regions": 420,
    "alpha_weight": 45.0, "alpha_residual_weight": 90.0, "max_residual": 12.0, "min_regions": 2, "gradient_stops": 5, "flat_tolerance": 2.0, "gradient_gain": 1.0,
    "stop_prune_tolerance": 1.4, "fit_sample_limit": 2500, "seam_overlap": 1, "base_layer": True, "corner_angle": 62.0, "smooth_passes": 4, "precision": 1, "min_path_area": 0.6, "denoise": 0,
}
#: What each preset changes.
PRESETS = {
    "icon": {"init_clusters": 28, "max_initial_regions": 800, "merge_tolerance": 0.8, "curve_tolerance": 0.35},
    "illustration": {"init_clusters": 40, "max_initial_regions": 1000, "merge_tolerance": 0.8, "curve_tolerance": 0.40},
    "photo": {"init_clusters": 80, "max_initial_regions": 1500, "min_regions": 60, "supersample": 3, "merge_tolerance": 0.8, "curve_tolerance": 0.5, "smooth_passes": 5, "max_residual": 20.0},
    "poster": {"denoise": 3, "init_clusters": 16, "min_region_px": 220, "max_initial_regions": 140, "min_regions": 8, "supersample": 2, "merge_tolerance": 6.0, "curve_tolerance": 1.2, "smooth_passes": 6, "max_residual": 30.0, "gradient_gain": 0.4},
}
#: Factors on merging, curves and the region budget, and the largest super-sampling.
TIERS = {"fast": (2.0, 1.8, 0.35, 2), "balanced": (1.0, 1.0, 1.0, 4), "max": (0.4, 0.7, 2.0, 4)}


#: The stages of a job in order.
JOB_STAGES = ("queued", "load", "palette", "regions", "merge", "document", "write")


def settings(preset: str, quality: str = "balanced", overrides: dict | None = None) -> dict:
    """The base, the preset, the tier's factors, and overrides that are not None, in this order."""
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {', '.join(sorted(PRESETS))}")
    if quality not in TIERS:
        raise ValueError(f"quality must be one of {', '.join(sorted(TIERS))}")
    out = BASE | PRESETS[preset]
    merge, curve, budget, most = TIERS[quality]
    out |= {"merge_tolerance": out["merge_tolerance"] * merge, "curve_tolerance": out["curve_tolerance"] * curve, "supersample": min(out["supersample"], most), "max_initial_regions": max(16, round(out["max_initial_regions"] * budget))}
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}


def settings_table(spark: SparkSession) -> DataFrame:
    """A row for each preset and tier."""
    names = sorted(settings("icon"))
    rows = [(p, q, *(settings(p, q)[n] for n in names)) for p in sorted(PRESETS) for q in sorted(TIERS)]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    first = settings("icon")
    return spark.createDataFrame(rows, "preset string, quality string, " + ", ".join(f"{n} {kinds[type(first[n])]}" for n in names))


def adapted_clusters(flatness: Column, carrying: Column, clusters: Column, min_clusters: int = 10, cap_flatness: float = 0.35, headroom: float = 1.0) -> Column:
    """Clusters for an image's content: fewer the flatter it is, and no more than the colours that carry it."""
    fewer = F.greatest(F.lit(min_clusters), F.bround(clusters * (d(1) - d(0.62) * flatness)).cast("int"))
    cap = F.greatest(F.lit(4), F.bround(carrying * d(headroom)).cast("int"))
    return F.greatest(F.lit(2), F.when((carrying > 0) & (flatness >= d(cap_flatness)), F.least(fewer, cap)).otherwise(fewer))


def supersample_cap(width: Column, height: Column) -> Column:
    longest = F.greatest(width, height)
    return F.when(longest > 1400, 1).when(longest > 700, 2).when(longest > 360, 3).otherwise(4)


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each job."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.struct(*order)).alias("__last")).select(key, "__last.*")


def stale(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that were not finished with the same options."""
    return inputs.join(done, keys, "left_anti")


def collisions(named: DataFrame) -> DataFrame:
    """named (source, destination) with the number of sources that go to one destination."""
    return named.withColumn("rivals", F.count("*").over(Window.partitionBy("destination")) - 1)


def report(results: DataFrame) -> DataFrame:
    """One row: how many, the mean similarity of those that have one, bytes, seconds, and the share that failed."""
    return results.agg(F.count_if("ok").alias("converted"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.sum("svg_bytes").alias("svg_bytes"), F.round(F.sum("seconds"), 6).alias("seconds"))


def compare(now: DataFrame, baseline: DataFrame, slack: float = 0.01) -> DataFrame:
    """Baseline names whose score is missing now, or lower by more than slack."""
    met = baseline.withColumnRenamed("score", "was").join(now, "name", "left")
    return met.filter(F.col("score").isNull() | (F.col("score") < F.col("was") - d(slack))).select("name", "was", "score", F.when(F.col("score").isNull(), "missing").otherwise("lower").alias("complaint"))


def overlay(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Known keys only; an own value wins."""
    return defaults.join(own.select("key", F.col("value").alias("own")), "key", "left").select("key", F.coalesce("own", "value").alias("value"))


def warnings(kind: Column, preset: Column, downscaled: Column) -> Column:
    photo = F.when((kind == "photo") & ~preset.isin("photo", "poster"), "photographic content under a drawing preset")
    return F.array_compact(F.array(photo, F.when(downscaled, "the image was reduced")))


def total(name: str) -> Column:
    """An aggregate: the sum of doubles by way of decimals of twelve places, so that order does not matter; a plain sum where a value, or the sum, is no such decimal."""
    exact = F.col(name).try_cast("decimal(38,12)")
    plain = F.count_if(F.col(name).isNotNull() & exact.isNull()) > 0
    return F.coalesce(F.when(~plain, F.try_sum(exact).cast("double")), F.sum(name))


def batch_summary(results: DataFrame, most_notes: int = 6) -> DataFrame:
    """One row: images, mean similarity of those scored, bytes, summed seconds, the first notes by name, and how many more there are. results: name, similarity, svg_bytes, seconds, note (null for none)."""
    order = Window.orderBy("name")
    sums = results.agg(F.count("*").alias("images"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.sum("svg_bytes").cast("long").alias("svg_bytes"), F.round(total("seconds"), 6).alias("seconds"), F.count("note").alias("__notes"))
    first = results.filter("note IS NOT NULL").orderBy("name").limit(most_notes).withColumn("__at", F.row_number().over(order)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "note"))), lambda s: s["note"]), "; ").alias("notes"))
    return sums.crossJoin(F.broadcast(first)).withColumn("more_notes", F.greatest(F.lit(0), F.col("__notes") - most_notes)).drop("__notes")


def ramp_count(paints: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    return paints.groupBy(*keys).agg(F.count_if(F.col(kind) != "flat").alias("gradients"))


def selected(jobs: DataFrame, done: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """The jobs to run: those of only, whether stale or not, or without it the stale ones. Unknown keys in only run nothing."""
    return stale(jobs, done, keys) if only is None else jobs.join(only, only.columns, "left_semi")


def outdated_count(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return stale(jobs, done, keys).agg(F.count("*").alias("outdated"))


def rejected(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """files (path, ord, length) with the reason why one is not taken: missing, unsupported, or a path that came before; null for the others."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    again = F.row_number().over(Window.partitionBy("path").orderBy("ord")) > 1
    return files.withColumn("reason", F.when(F.col("length").isNull(), "missing").when(~suffix.isin(*suffixes), "unsupported").when(again, "duplicate"))


def collected(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """The paths of files (path, ord, length) that are there and supported, each where it first came."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(F.col("length").isNotNull() & suffix.isin(*suffixes)).groupBy("path").agg(F.min("ord").alias("ord"))


def uploads(rows: DataFrame, suffixes: tuple[str, ...], most_bytes: int = 64 << 20) -> DataFrame:
    """rows (name, payload in base64) with content and the reason why one is refused: suffix, empty, not base64, too large."""
    suffix = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    whole = F.regexp_like(F.col("payload"), F.lit(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    size = (F.length("payload") / 4 * 3).cast("long") - F.length(F.regexp_extract("payload", "=*$", 0))
    reason = F.when(~suffix.isin(*suffixes), "suffix").when(F.coalesce(F.length("payload"), F.lit(0)) == 0, "empty").when(~whole, "not base64").when(size > most_bytes, "too large")
    return rows.withColumn("reason", reason).withColumn("content", F.when(F.col("reason").isNull(), F.unbase64("payload")))


def job_id(*columns: Column) -> Column:
    """Twelve hexadecimal digits that name a job."""
    return F.substring(F.sha2(F.concat_ws("/", *(c.cast("string") for c in columns)), 256), 1, 12)


def progress(stage: Column) -> Column:
    """The share of stages before this one; 0 for an unknown one."""
    place = F.array_position(F.array(*map(F.lit, JOB_STAGES)), F.coalesce(stage, F.lit("")))
    return F.greatest(place - 1, F.lit(0)).cast("double") / d(len(JOB_STAGES))


def queue_states(log: DataFrame, key: str = "job", order: str = "at") -> DataFrame:
    """The jobs still in the queue with their last state, and how often a removal was refused since the job ran. log: job, at, action (add, start, done, failed, remove)."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(F.when(F.col("action") != "remove", F.col("action")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = log.withColumn("refused", (F.col("action") == "remove") & F.coalesce(before == "start", F.lit(False)))
    last = told.filter("NOT refused").groupBy(key).agg(F.max_by("action", order).alias("action"))
    tally = told.groupBy(key).agg(F.count_if("refused").alias("refused"))
    state = F.when(F.col("action") == "start", "running").when(F.col("action") == "add", "queued").otherwise(F.col("action"))
    return last.join(tally, key).filter("action <> 'remove'").select(key, state.alias("state"), "refused")


def rerun(done: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """done without the jobs of only, or without any: what is not in it is stale and runs again."""
    return done.limit(0) if only is None else done.join(only, keys, "left_anti")
