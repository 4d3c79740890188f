"""Toxicity by non-negative positive-unlabelled learning.

Words are scored by learned weights of hashed letter n-grams, affixes and whole words, and a text's score is a soft
maximum over its words, so that a few words decide in texts of any length. Training sees confirmed toxic texts and
unlabelled ones. With the class prior p, the sigmoid loss l and the three means over texts, the risk is

    p * E_toxic[l(+)] + max(0, E_unlabelled[l(-)] - p * E_toxic[l(-)])

and where the second term falls below zero, a step goes up its slope only, which keeps it from being fitted to noise.
The bias that the risk leads to, by way of the prior, turns a text's score into a probability; labelled clean texts are
used for the prior alone.

Defined cases: a null text, or one without a letter, gets the lowest score there is, that of no word; equal texts get
equal scores; without a confirmed toxic text every score is 0; an empty table gives an empty result. Only the id and the
text are read to score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, hash_sample, span
from .lexical import Words

ORDERS, BITS, WHOLE_BITS = (3, 4, 5), 17, 18
#: Texts at most that are confirmed toxic and unlabelled; characters of each, half of them from either end of a longer one.
TOXIC_ROWS, UNLABELLED_ROWS, SAMPLE_CHARS = 1200, 2400, 2400
STEPS, RATE, SHARP = 60, 0.3, 4.0


@dataclass
class Model:
    grams: np.ndarray
    whole: np.ndarray
    bias: float = 0.0
    trained: bool = False

    @staticmethod
    def empty() -> Model:
        return Model(np.zeros(len(ORDERS) * (1 << BITS) + 1, np.float32), np.zeros((1 << WHOLE_BITS) + 1, np.float32))


def _features(words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    out = []
    for at, n in enumerate(ORDERS):
        of = words.grams(n, BITS)
        out.append(np.where(of > 0, of + at * (1 << BITS), 0))
    return out, words.whole(WHOLE_BITS)


def _word_scores(model: Model, words: Words, ids: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    values = model.grams[ids[0]]
    for more in ids[1:]:
        values += model.grams[more]
    return words.sum_by_word(values) + model.whole[whole]


def _soft_max(scores: np.ndarray, counts: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """For each text log(sum(exp(SHARP * score))) / SHARP over its words and a word of score floor, and each word's share in it."""
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    high = np.full(n, floor)
    full = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[full]
    if len(full):
        high[full] = np.maximum(np.maximum.reduceat(scores, begin), floor)
    e = np.exp(SHARP * (scores - high[text]))
    total = np.bincount(text, e, n) / np.maximum(counts, 1) + np.exp(SHARP * (floor - high))
    return high + np.log(total) / SHARP, e / np.maximum(counts, 1)[text] / total[text]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _unique_words(texts: list[str]) -> list[str]:
    """Each text with every word once, in order: presence is what counts."""
    return [" ".join(dict.fromkeys((t or "").lower().split())) for t in texts]


def risk_slopes(z: np.ndarray, is_toxic: np.ndarray, prior: float) -> np.ndarray:
    """For each text the slope to follow downwards: of the risk, or where the unlabelled part of it is below zero, of minus that part."""
    s = sigmoid(z)
    slope = s * (1 - s)  # of the loss sigmoid(z) that a text is not toxic; minus it of the one that it is
    p, n_u = is_toxic.sum(), (~is_toxic).sum()
    inner = s[~is_toxic].mean() - prior * s[is_toxic].mean()
    unlabelled_part = np.where(is_toxic, -prior / p, 1 / n_u) * slope
    toxic_part = np.where(is_toxic, -prior / p, 0.0) * slope
    return toxic_part + unlabelled_part if inner >= 0 else -unlabelled_part


def train(toxic: list[str], unlabelled: list[str], prior: float, steps: int = STEPS, rate: float = RATE) -> Model:
    model = Model.empty()
    if not toxic or not unlabelled:
        return model
    words = Words(_unique_words(toxic + unlabelled))
    ids, whole = _features(words)
    p = len(toxic)
    is_toxic = np.arange(len(words.counts)) < p
    by_letter = np.repeat(np.arange(len(words.starts), dtype=np.int32), words.sizes)

    def spread(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters = value[by_letter]
        g = sum(np.bincount(i, letters, len(model.grams)) for i in ids)
        g[0] = 0
        return g, np.bincount(whole, value, len(model.whole))

    # begin from how much more often a feature stands in toxic texts than in unlabelled ones, held back for rare ones
    for table, feats, text in ((model.grams, ids, words.text[by_letter]), (model.whole, [whole], words.text)):
        for of in feats:
            seen = np.unique(of.astype(np.int64) * len(words.counts) + text)
            feature, where = seen // len(words.counts), seen % len(words.counts)
            a = np.bincount(feature[where < p], minlength=len(table)) / p
            b = np.bincount(feature[where >= p], minlength=len(table)) / max(1, len(unlabelled))
            table += np.clip(np.log((a + 0.01) / (b + 0.01)), 0, 2).astype(np.float32) * 0.5
        table[0] = 0
    bias, bias_total = -2.0, 1e-6
    totals = [np.full(len(model.grams), 1e-6), np.full(len(model.whole), 1e-6)]
    for _ in range(steps):
        score, share = _soft_max(_word_scores(model, words, ids, whole), words.counts)
        by_text = risk_slopes(score + bias, is_toxic, prior)
        grads = spread(by_text[words.text] * share)
        for table, g, total in zip((model.grams, model.whole), grads, totals, strict=True):
            total += g * g
            table -= (rate * g / np.sqrt(total)).astype(np.float32)
            table *= 0.9995
        g = by_text.sum()
        bias_total += g * g
        bias -= rate * g / bias_total**0.5
    model.bias, model.trained = bias, True
    return model


def raw_scores(model: Model, texts: list[str]) -> np.ndarray:
    """The soft maximum for each text, over all of its words."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 400_000):
            size += len(texts[end])
            end += 1
        words = Words(texts[at:end])
        out[at:end] = _soft_max(_word_scores(model, words, *_features(words)), words.counts)[0]
        at = end
    return out


def score(model: Model, texts: list[str]) -> np.ndarray:
    return sigmoid(raw_scores(model, texts) + model.bias) if model.trained else np.zeros(len(texts))


def learn(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, label: str = "toxic", steps: int = STEPS) -> Model:
    """A model from rows outside the held-out part: the prior from all labels, and bounded samples by a hash of doc_id, of confirmed toxic texts and of all texts as unlabelled ones."""
    known = labels.filter(F.col(label).isNotNull() & (crc_bucket("doc_id", parts) != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    prior = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    if not prior:
        return Model.empty()
    chosen = F.broadcast(hash_sample(known.filter("y = 1").select("doc_id"), TOXIC_ROWS, "doc_id", seed=11))  # at most so many rows
    texts = docs.select("doc_id", span("text", SAMPLE_CHARS).alias("text")).filter("text <> ''")
    met = texts.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TOXIC_ROWS).collect()  # doc_id may repeat
    loose = hash_sample(texts.filter(crc_bucket("doc_id", parts) != held), UNLABELLED_ROWS, "doc_id", seed=13, of=docs).collect()
    in_order = lambda rows: [t for _, t in sorted((r.doc_id, r.text) for r in rows)]
    return train(in_order(met), in_order(loose), prior, steps)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(model, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(told, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below least."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(model, [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield batch.filter(pa.array(values < least))

    return docs.mapInArrow(kept, docs.schema)


def evaluate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from those that are not held out."""
    model = learn(docs, labels)
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
