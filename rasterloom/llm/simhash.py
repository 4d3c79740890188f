"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits. Of at most four differing bits, two of the three
segments have at most two each, and two such segments share a Golay index each (see golay). So the keys are the pairs
of indices of two segments: equal keys find every link, and the bits are compared within a key.

Each distinct fingerprint is keyed once, however many documents have it. Within a key, fingerprints are linked by a
search that takes found ones out, so a dense group costs about its size and yields a spanning forest, not all pairs.
Keys that hold very many fingerprints are split into pairs of chunks, which keeps a task's memory bounded.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any other; equal
rows are kept and share a component; rows with a null doc_id keep it and belong to the component of their fingerprint,
whose id is null if all of its ids are; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut
from .components import connected
from .golay import indices

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one key that a task may hold; the share of fingerprints by which larger keys are looked for.
KEY_ROWS, KEY_SHARE = 65_536, 64
_SEGMENTS = ((42, 22), (21, 21), (0, 21))


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of the XXH64 of a text's k-word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) > k else iter([b" ".join(words)])
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(words) - k + 1)))


def majority(hashes: np.ndarray) -> int:
    """64 bits as a signed number: those that are set in over half of the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (fingerprint(x.as_py() or b"", k, seed) for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.fromiter(values, np.int64, batch.num_rows))], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return chosen.mapInArrow(made, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position in fps): a key is the number of a pair of segments and an index of each."""
    of = fps.view(np.uint64)
    found = [indices((of >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in _SEGMENTS]
    keys, rows = [], []
    slot = np.arange(6)
    for number, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        (kx, nx), (ky, ny) = found[x], found[y]
        key = (kx[:, :, None] << 12 | ky[:, None, :]) | number << 24
        own = (slot < nx[:, None])[:, :, None] & (slot < ny[:, None])[:, None, :]
        keys.append(key[own])
        rows.append(np.broadcast_to(np.arange(len(fps))[:, None, None], own.shape)[own])
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 4096):
            part = np.ascontiguousarray(fps[at : at + 4096])
            keys, rows = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join every two of fps that differ in at most bits bits: what a search finds leaves the rest."""
    out, left = [], fps.view(np.uint64)
    while len(left) > 1:
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= bits
            if near.any():
                hit, left = left[near], left[~near]
                out.append((np.full(len(hit), root), hit))
                queue += list(hit)
    return out


class Runs:
    """Takes sorted rows in batches and hands on each run of equal keys whole; the last one waits for the next batch."""

    def __init__(self):
        self.keys, self.fps = [], []

    def feed(self, keys: np.ndarray, fps: np.ndarray):
        if not len(keys):
            return None
        last = np.searchsorted(keys, keys[-1], "left")
        if self.keys and last == 0 and self.keys[-1][-1] == keys[0]:
            self.keys.append(keys)
            self.fps.append(fps)
            return None
        out = (np.concatenate([*self.keys, keys[:last]]), np.concatenate([*self.fps, fps[:last]]))
        self.keys, self.fps = [keys[last:]], [fps[last:]]
        return out

    def rest(self):
        return (np.concatenate(self.keys), np.concatenate(self.fps)) if self.keys else None


def links_in(keys: np.ndarray, fps: np.ndarray, bits: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys: all pairs of small runs, a spanning forest of others."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    lengths = ends - starts
    out = []
    few = np.repeat((lengths > 1) & (lengths <= small), lengths)
    at = np.flatnonzero(few)
    for step in range(1, small):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        x, y = fps[at], fps[at + step]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= bits
        out.append((x[near], y[near]))
    for run in np.flatnonzero(lengths > small):
        out += [(x.view(np.int64), y.view(np.int64)) for x, y in forest(fps[starts[run] : ends[run]], bits)]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def sampled(column: str) -> Column:
    """True for the share of rows by which heavy keys are looked for."""
    return F.pmod(F.xxhash64(column), F.lit(KEY_SHARE)) == 0


def split_heavy(keyed: DataFrame, part: DataFrame, node: str, key_rows: int, most_keys: int | None = None) -> DataFrame:
    """keyed with the rows of heavy keys sent to every pair of chunks that has theirs, under a key of its own, so that all pairs still meet while a task holds about key_rows rows of a key.

    part, the rows of a sample of nodes, only says which keys are heavy; a wrong guess costs memory, never a pair. most_keys: a bound on the number of its keys, if one is known.
    """
    heavy = cut(part.groupBy("key").count().filter(F.col("count") * KEY_SHARE > key_rows).select("key", F.ceil(F.col("count") * (4 * KEY_SHARE) / key_rows).cast("int").alias("chunks")), most_keys)
    if heavy.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64(node, F.lit(7)), F.col("chunks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    dealt = keyed.join(broadcast_if_small(heavy), "key", "left")
    light = dealt.filter("chunks IS NULL").select(keyed.columns)
    return light.unionByName(dealt.filter("chunks IS NOT NULL").withColumn("key", F.explode(met)).select(keyed.columns))


def link(fps: DataFrame, bits: int = MAX_BITS, key_rows: int = KEY_ROWS, most: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints in fps (column fp) that connect all that differ in at most bits bits. most: a bound on the number of fingerprints, if one is known."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be from 0 to {MAX_BITS}: beyond that two segments may have more than two errors")
    expand = lambda df: df.select("fp").mapInArrow(_keyed, "key long, fp long")
    keyed = split_heavy(expand(fps), expand(fps.filter(sampled("fp"))), "fp", key_rows, most and 2 * most)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            if whole := runs.feed(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                x, y = links_in(*whole, bits)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        if whole := runs.rest():
            x, y = links_in(*whole, bits)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(linked, "a long, b long").distinct()


def components(marked: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """marked (doc_id, fp; read more than once) with component_id: the smallest doc_id that links reach."""
    most = marked.count()
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), most)
    roots = connected(link(classes, bits, most=most))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), most)  # cut, so that what joins it by one large component can be split
    named = cut(rooted.join(broadcast_if_small(least), "root").select("fp", "component_id"), most)
    return marked.join(broadcast_if_small(named), "fp", "left")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = components(cut(fingerprints(docs, k, seed)), bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
