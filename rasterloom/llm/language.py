"""Language identification of code-switched text by a linear-chain conditional random field.

Each word is a place in the chain. Its score for a language is the sum of learned weights of its letter n-grams, of
its affixes (n-grams at its beginning or end are features of their own) and of the whole word (the lexicon); learned
transitions join neighbours, and learned start weights open the chain. Forward-backward gives each word's marginals. A text's language is a softmax over the
mean marginals of all its words, of its first words and of its last ones, with learned weights: inserts in another
language can be long, while a text begins and ends in its own.

Learning has two rounds: words first count as their text's language; then words whose marginals say otherwise are
relabelled, so that switches within texts teach the transitions.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts with equal letters get equal
results; if no text is labelled all others are ``und`` too; an empty table gives an empty result. Only the id and the text are
read to predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, span
from .lexical import Words

UNKNOWN = "und"
ORDERS, BITS, LEXICON_BITS = (2, 3, 4), 16, 17
#: Training texts at most, and characters of each, half of them from either end of a longer one; words at either end that count on their own.
SAMPLE_ROWS, SAMPLE_CHARS, EDGE = 1600, 6000, 12
EPOCHS, RATE, BATCH = 3, 0.5, 100
#: Words whose scores a task holds at once, unless one text has more.
MOST_WORDS = 3_000_000


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    head: np.ndarray

    @staticmethod
    def empty(langs: list[str]) -> Model:
        k = len(langs)
        return Model(langs, np.zeros((len(ORDERS) * (1 << BITS) + 1, k), np.float32), np.zeros(((1 << LEXICON_BITS) + 1, k), np.float32), np.eye(k) * 2.0, np.zeros(k), np.array([2.0, 3.0, 3.0]))


def features(words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    ids = []
    for at, n in enumerate(ORDERS):
        of = words.grams(n, BITS)
        ids.append(np.where(of > 0, of + at * (1 << BITS), 0))
    return ids, words.whole(LEXICON_BITS)


def emissions(model: Model, words: Words) -> np.ndarray:
    ids, lexicon = features(words)
    values = model.grams[ids[0]]
    for more in ids[1:]:
        values += model.grams[more]
    return words.sum_by_word(values) + model.lexicon[lexicon]


def marginals(model: Model, scores: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each word's marginals for chains of the given lengths one after another, and with pairs the expected transitions. Chains advance together, longest first."""
    k = scores.shape[1] if scores.size else len(model.langs)
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(most), "left") if most else np.empty(0, np.int64)  # chains longer than t
    e = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    t_matrix = np.exp(model.transition - model.transition.max()).astype(e.dtype)
    alpha = np.empty_like(e)
    a = None
    for t in range(most):
        at = begin[: active[t]] + t
        a = np.exp(model.start).astype(e.dtype) * e[at] if t == 0 else (a[: len(at)] @ t_matrix) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    expected = np.zeros((k, k))
    b = np.ones((0, k), e.dtype)
    for t in range(most - 1, -1, -1):
        at = begin[: active[t]] + t
        if len(b):
            ahead = e[begin[: len(b)] + t + 1] * b
            back = ahead @ t_matrix.T
            if pairs:
                joint = alpha[at[: len(b)]][:, :, None] * t_matrix[None] * ahead[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = np.concatenate([back, np.ones((len(at) - len(b), k), e.dtype)]) if len(b) else np.ones((len(at), k), e.dtype)
        b /= b.sum(1, keepdims=True)
        m = alpha[at] * b
        alpha[at] = m / m.sum(1, keepdims=True)
    return alpha, expected


def evidence(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the mean marginals of all words, of the first and of the last EDGE ones: (texts, 3, languages)."""
    out = np.zeros((len(counts), 3, m.shape[1]))
    full = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[full]
    if len(full):
        out[full, 0] = np.add.reduceat(m, begin, axis=0) / counts[full, None]
        edge = np.minimum(counts[full], EDGE)
        spans = lambda first: np.add.reduceat(np.concatenate([m, np.zeros((1, m.shape[1]), m.dtype)]), np.stack([first, first + edge], 1).ravel(), axis=0)[::2]
        out[full, 1] = spans(begin) / edge[:, None]
        out[full, 2] = spans(begin + counts[full] - edge) / edge[:, None]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """The same model for the same rows in the same order."""
    model = Model.empty(sorted(set(langs)))
    k = len(model.langs)
    if k < 2:
        return model
    target_of = np.array([model.langs.index(x) for x in langs])
    batches = []
    for at in range(0, len(texts), BATCH):
        words = Words(texts[at : at + BATCH])
        if len(words.starts):
            batches.append((words, *features(words), target_of[at : at + BATCH][words.text]))
    totals = {"grams": np.full_like(model.grams, 1e-3), "lexicon": np.full_like(model.lexicon, 1e-3)}
    scatter = lambda ids, g, n: np.stack([np.bincount(ids, g[:, j], n) for j in range(k)], 1).astype(np.float32)
    observed, expected = np.ones((k, k)), np.ones((k, k))
    opened, awaited = np.ones(k), np.ones(k)
    for relabelled in (False, True):
        targets = []
        for words, ids, lexicon, y in batches:
            if relabelled:
                m, _ = marginals(model, emissions(model, words), words.counts)
                y = np.where(m.max(1) > 0.9, m.argmax(1), y)
            targets.append(y)
        for _ in range(epochs):
            observed[:], expected[:], opened[:], awaited[:] = 0.5, 0.5, 0.5, 0.5
            for (words, ids, lexicon, _), y in zip(batches, targets, strict=True):
                m, pairs = marginals(model, emissions(model, words), words.counts, pairs=True)
                g = -m
                g[np.arange(len(y)), y] += 1
                by_letter = np.repeat(g, words.sizes, axis=0)
                grad = sum(scatter(i, by_letter, len(model.grams)) for i in ids)
                grad[0] = 0
                for name, value in (("grams", grad), ("lexicon", scatter(lexicon, g, len(model.lexicon)))):
                    table = getattr(model, name)
                    totals[name] += value * value
                    table += rate * value / np.sqrt(totals[name])
                    table *= 0.999
                same = words.text[1:] == words.text[:-1]
                np.add.at(observed, (y[:-1][same], y[1:][same]), 1)
                expected += pairs
                first = np.append(True, ~same)
                np.add.at(opened, y[first], 1)
                awaited += m[first].sum(0)
            model.start = np.clip(model.start + 0.5 * (np.log(opened) - np.log(awaited)), -6, 6)
            model.transition = np.clip(model.transition + 0.5 * (np.log(observed) - np.log(expected)), -6, 6)
    seen, right = [], []
    for at in range(0, len(texts), BATCH):
        words = Words(texts[at : at + BATCH])
        if len(words.starts):
            seen.append(evidence(marginals(model, emissions(model, words), words.counts)[0], words.counts)[words.counts > 0])
            right.append(target_of[at : at + BATCH][words.counts > 0])
    x, y = np.concatenate(seen), np.concatenate(right)
    for _ in range(300):
        p = softmax(np.einsum("tel,e->tl", x, model.head))
        p[np.arange(len(y)), y] -= 1
        model.head = np.maximum(model.head - 2.0 * np.einsum("tl,tel->e", p, x) / len(y), 0)
    return model


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """A language and its probability for each text. Scores are made in small blocks, chains run over many texts together."""
    langs, probability = [UNKNOWN] * len(texts), np.zeros(len(texts))
    scores, counts, rows = [], [], []

    def flush() -> None:
        n = np.concatenate(counts)
        of = np.concatenate(rows)
        p = softmax(np.einsum("tel,e->tl", evidence(marginals(model, np.concatenate(scores), n)[0], n), model.head))
        for i, known, row in zip(of, n > 0, p, strict=True):
            if known:
                langs[i], probability[i] = model.langs[int(row.argmax())], row.max()

    held = block = 0
    while block < len(texts):
        end, size = block, 0
        while end < len(texts) and (end == block or size + len(texts[end]) <= 400_000):
            size += len(texts[end])
            end += 1
        if model.langs:
            words = Words(texts[block:end])
            scores.append(emissions(model, words))
            counts.append(words.counts)
            rows.append(np.arange(block, end))
            held += len(words.starts)
            if held > MOST_WORDS:
                flush()
                scores, counts, rows, held = [], [], [], 0
        block = end
    if rows:
        flush()
    return langs, probability


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """most rows shared out evenly, where what a language lacks goes to the others."""
    out, left = {}, most
    for at, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], left // (len(counts) - at))
        left -= out[lang]
    return out


def training_rows(docs: DataFrame, most: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, parts: int = 4, held: int = 2) -> list[tuple[str, str]]:
    """At most most labelled texts, as many of each language as there are or its share of most, by a hash of doc_id, outside the held-out part; spans of those over chars characters."""
    use = docs.filter(F.col("lang").isNotNull() & (crc_bucket("doc_id", parts) != held))
    counts = {r.lang: r["count"] for r in use.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    share = {lang: min(1.0, 3 * n / counts[lang]) for lang, n in quotas(counts, most).items() if n}
    if not share:
        return []
    # rows are thinned by the hash before they meet, at three times the share needed, so that few are moved
    part = F.create_map(*(x for lang, p in share.items() for x in (F.lit(lang), F.lit(int(p * (1 << 40))))))
    h = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40))
    thin = use.select("doc_id", "lang", h.alias("h"), span("text", chars).alias("text")).filter((F.col("h") < F.try_element_at(part, F.col("lang"))) & (F.col("text") != ""))
    ranked = thin.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text")))
    limits = F.create_map(*(x for lang, n in quotas(counts, most).items() for x in (F.lit(lang), F.lit(n))))
    rows = ranked.filter(F.col("place") <= F.try_element_at(limits, F.col("lang"))).collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.text))]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, p = predict(model, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(told, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def evaluate(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    rows = training_rows(docs)
    model = train([t for t, _ in rows], [x for _, x in rows])
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
