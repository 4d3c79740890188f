"""Quality rules: statistics of whole texts and decision lists learned from labelled ones, in DataFrame operations only.

All statistics of a text are made inside its row; nothing is exploded or shuffled. A decision list is grown by
sequential covering: a conjunction of thresholds is grown on one part of the labelled statistics by information gain,
pruned on the other part, and kept while it is precise enough; the rows it covers then leave. The list becomes one
ordered conditional expression.

Defined cases: a null text has no words, no lines and fails the base rules; ties between conditions go to the first
feature and the smaller threshold; repeated rows are judged alike; with no labelled rows, or labels of one kind, the
list is empty and keeps all that passes the base rules; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS, MOST_REPEAT = 10, 20
#: Labelled rows that a list is learned from at most, chosen by a hash of their id.
LABELLED_ROWS = 20_000
BINS, MOST_RULES, MOST_CONDITIONS, MIN_COVER, MIN_PRECISION = 32, 12, 4, 8, 0.9


def statistics(docs: DataFrame, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of keep, doc_id, and per text n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_upper, n_marks.

    Windows are compared by 64-bit hashes of word hashes. Only texts in which a window repeats get their windows sorted.
    The steps are apart so that no array is computed anew for each of its elements.
    """
    trimmed = F.trim(F.col(text), F.lit(WHITE))
    first = docs.select(*keep, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+", -1)).alias("__w0"))
    words = first.withColumn("__w", F.coalesce("__w0", F.array().cast("array<string>"))).drop("__w0")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    hashed = words.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x))).withColumn("__l", lines)
    counted = hashed.select(
        *keep, "doc_id", "__h",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__h")).cast("long").alias("n_distinct"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("__t", F.lit("[!?.,;:]+")).cast("long").alias("n_marks"),
    )
    window = F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("__h", i + k) for k in range(1, WINDOW))))
    windowed = counted.withColumn("__g", window).withColumn("__repeats", F.size(F.array_distinct("__g")) < F.size("__g"))
    ordered = windowed.withColumn("__s", F.when(F.col("__repeats"), F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("k"), i.alias("p"))))))
    same = lambda x, i: F.coalesce(F.get("__s", i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["k"] == x["k"], F.lit(False))
    starts = ordered.withColumn("__p", F.array_sort(F.transform(F.filter("__s", same), lambda x: x["p"])))
    covered = F.aggregate("__p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(WINDOW))).alias("n")), lambda a: a["n"])
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__g", "__repeats", "__s", "__p")


def features() -> dict[str, Column]:
    """What a list's thresholds are on; never null."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "line_repeat": share("n_dup_lines", "n_lines"),
        "word_repeat": share("n_repeat_words", "n_words"),
        "variety": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; what none of them covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def kept(self) -> Column:
        found = F.when(F.lit(False), F.lit(True))
        for rule in self.rules:
            every = F.lit(True)
            for c in rule:
                every = every & c.column()
            found = found.when(every, F.lit(False))
        return found.otherwise(F.lit(True))

    def keeps(self, row: dict[str, float]) -> bool:
        return not any(all(c.holds(row) for c in rule) for rule in self.rules)

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nelse keep"


Row = tuple[dict[str, float], bool]


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """First-order inductive learner gain of going from (bad, good) to (bad, good)."""
    if not after[0] or not before[0]:
        return 0.0
    return after[0] * (math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before)))


def _counts(rows: Sequence[Row]) -> tuple[int, int]:
    bad = sum(b for _, b in rows)
    return bad, len(rows) - bad


def _grow(rows: Sequence[Row], edges: dict[str, list[float]]) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < MOST_CONDITIONS and (now := _counts(rows))[1]:
        best, least = None, 1e-9
        for name, cuts in edges.items():
            ordered = sorted((r[name], b) for r, b in rows)
            k = bad = 0
            for cut in cuts:
                while k < len(ordered) and ordered[k][0] <= cut:
                    bad += ordered[k][1]
                    k += 1
                low, high = (bad, k - bad), (now[0] - bad, now[1] - (k - bad))
                for above, part in ((False, low), (True, high)):
                    if part[0] >= MIN_COVER and (g := _gain(now, part)) > least:
                        best, least = Condition(name, above, cut), g
        if best is None:
            break
        rule = (*rule, best)
        rows = [x for x in rows if best.holds(x[0])]
    return rule


def _prune(rule: tuple[Condition, ...], rows: Sequence[Row]) -> tuple[Condition, ...]:
    """The beginning of the rule that does best on rows kept apart; the longer one on a tie."""

    def worth(part: tuple[Condition, ...]) -> float:
        bad, good = _counts([x for x in rows if all(c.holds(x[0]) for c in part)])
        return (bad - good) / (bad + good) if bad + good else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(rows: Sequence[Row], bins: int = BINS) -> DecisionList:
    """A list from (features, is it bad) of labelled texts; a third of them, every third one, prunes."""
    rules: list[tuple[Condition, ...]] = []
    left = list(rows)
    edges: dict[str, list[float]] = {}
    for name in features() if rows else ():
        values = sorted({r[name] for r, _ in rows})
        step = max(1, len(values) / bins)
        picked = sorted({values[int(i * step)] for i in range(bins) if int(i * step) < len(values)} | {values[0]})
        edges[name] = [(v + values[values.index(v) + 1]) / 2 if v != values[-1] else v for v in picked]
    while len(rules) < MOST_RULES:
        grow, prune = [x for i, x in enumerate(left) if i % 3], left[::3]
        rule = _prune(_grow(grow, edges), prune)
        bad, good = _counts([x for x in prune if all(c.holds(x[0]) for c in rule)])
        if not rule or bad < 2 or bad / (bad + good) < MIN_PRECISION:
            break
        rules.append(rule)
        left = [x for x in left if not all(c.holds(x[0]) for c in rule)]
    return DecisionList(tuple(rules))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, label: str = "quality") -> list[Row]:
    """Statistics of at most most labelled texts, chosen and ordered by a hash of doc_id, with whether the label is 0."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("__label"))
    few = F.broadcast(hash_sample(chosen, most, "doc_id"))  # at most most rows of two numbers
    met = statistics(docs.select("doc_id", "text").join(few, "doc_id"), keep=["__label"])
    told = met.select(F.xxhash64("doc_id").alias("h"), "doc_id", (F.col("__label") == 0).alias("bad"), F.struct(*(c.alias(n) for n, c in features().items())).alias("f"))
    got = told.orderBy("h", "doc_id", "f").limit(most).collect()  # doc_id may repeat
    return [(r.f.asDict(), r.bad) for r in got]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every text."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return statistics(docs).select(*columns, base_failed().alias("base_failed"), (~base_failed() & rules.kept()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base rules and the list."""
    found = statistics(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text"), keep=["__row"])
    # a filter is not moved below the generator that makes what it reads, so the statistics are made once for each row
    return found.select("__row", F.explode(F.array(~base_failed() & rules.kept())).alias("__kept")).filter("__kept").select("__row.*")
