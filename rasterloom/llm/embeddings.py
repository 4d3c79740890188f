"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by its nearest pivots, in order of nearness. It is listed under the first ``posted`` of them,
in the inverted list of that pivot and its label, with its whole description. Two vectors that share a list and at least
``shared`` pivots of their descriptions are candidates, and their cosine in double precision decides. A pair that shares
several lists is judged in the first one only, so links are counted once.

There are four pivots for each square root of the number of vectors, taken from a sample twice as large; every vector is
indexed. So a list holds about the square root of that number, and what is shuffled grows with the vectors until lists
outgrow a chunk. Longer lists are split into pairs of chunks, which bounds what a task holds; a chunk pair yields counts
of links and a spanning forest, never all pairs. Equal vectors are one class.

Defined cases: vectors that are null, zero, or hold null, infinite or not-a-number components, and those without a
label, link with nothing and are components of their own; vectors of different lengths do not link; equal rows link with
each other and share the smallest vec_id; a null vec_id is kept, comes after all others and names no component unless it
stands alone; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, hash_sample
from .components import connected

MIN_COSINE = 0.98
#: Pivots for each square root of the number of vectors, their least number, and rows of the sample for each.
PIVOTS, LEAST_PIVOTS, SAMPLE = 4, 32, 2
#: Pivots of a description, lists a vector is in, and pivots that candidates share.
DESCRIBED, POSTED, SHARED = 8, 4, 3
#: Vectors of one list that meet in one task.
CHUNK = 2048


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """The first rows of the sample, without those that repeat a direction already taken."""
    directions = unit(sample)
    picked = np.empty((0, directions.shape[1]))
    for at in range(0, len(directions), 256):
        part = directions[at : at + 256]
        part = part[(part @ picked.T < 0.9).all(1)]
        near, new = part @ part.T >= 0.9, []
        for i in range(len(part)):
            if not near[i, new].any():
                new.append(i)
        picked = np.concatenate([picked, part[new]])
        if len(picked) >= most:
            break
    return picked[:most]


def describe(x: np.ndarray, pivots: np.ndarray, length: int = DESCRIBED) -> np.ndarray:
    """Numbers of each unit row's nearest pivots, nearest first."""
    near = x @ pivots.T
    k = min(length, near.shape[1])
    part = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1).astype(np.int32)


def judge(pivot: int, x: np.ndarray, lists: np.ndarray, weight: np.ndarray, chunk: np.ndarray, cosine: float, posted: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of one list (or pair of its chunks): links of each with vectors of other classes, and the first vector of its group."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    apart = n > 0 and chunk.min() != chunk.max()  # equal chunks meet in a task of their own
    for at in range(0, n, 256):
        hit = x[at : at + 256] @ x.T >= cosine
        hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
        if apart:
            hit &= chunk[at : at + 256, None] != chunk[None, :]
        i, j = np.nonzero(hit)
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            same = lists[at + a][:, :, None] == lists[b][:, None, :]
            found = same.any(2).sum(1) >= min(shared, lists.shape[1])
            before = (same[:, :posted, :posted].any(2) & (lists[at + a][:, :posted] < pivot)).any(1)  # a pair is judged in the first list that it shares
            hit[a, b] = found & ~before
        links[at : at + 256] = hit @ weight
        for i in np.flatnonzero(hit.any(1)):
            near = root[hit[i]]
            low = min(root[at + i], near.min())
            if (near != low).any() or root[at + i] != low:
                root[np.isin(root, np.append(near, root[at + i]))] = low
    return links, root


def near_duplicates(vectors: DataFrame, cosine: float = MIN_COSINE, described: int = DESCRIBED, posted: int = POSTED, shared: int = SHARED, chunk_rows: int = CHUNK, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))))  # -0.0 and 0.0 are equal
    classes = cut(rows.filter("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("class", F.xxhash64("label", "v")).withColumn("dim", F.size("v")))
    most = max(LEAST_PIVOTS, round(PIVOTS * classes.count() ** 0.5))
    sample = sorted(hash_sample(classes.select("class", "v", "dim"), SAMPLE * most, "class", seed=1, of=classes).collect(), key=lambda r: r["class"])
    pivots = {d: choose_pivots(np.array([r.v for r in sample if r.dim == d]), most) for d in {r.dim for r in sample}}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = unit(np.stack([np.asarray(y, float) for y in part.column("v").to_pylist()]))
                if d not in pivots:  # too rare for the sample: one list holds its vectors
                    lists = np.zeros((len(x), 1), np.int32)
                else:
                    lists = describe(x, pivots[d], described)
                p = min(posted, lists.shape[1])
                again = pa.array(np.repeat(np.arange(len(x)), p))
                told = [pa.array(list(map(bytes, lists)), pa.binary()), pa.array(list(map(bytes, x)), pa.binary())]
                cols = [*(part.column(c).take(again) for c in names), pa.array(lists[:, :p].ravel()), *(c.take(again) for c in told)]
                yield pa.RecordBatch.from_arrays(cols, [*names, "pivot", "lists", "x"])

    names = ["label", "class", "n", "dim"]
    kind = rows.schema["label"].dataType.simpleString()
    posts = cut(classes.select(*names, "v").mapInArrow(listed, f"label {kind}, class long, n long, dim int, pivot int, lists binary, x binary"))
    sizes = cut(posts.groupBy("label", "dim", "pivot").count().select("label", "dim", "pivot", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks")).filter("chunks > 1"))
    dealt = posts.join(broadcast_if_small(sizes), ["label", "dim", "pivot"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(3)), F.col("chunks")).cast("int"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("lo", F.least("chunk", "j")).withColumn("hi", F.greatest("chunk", "j"))

    def told(run: pa.Table) -> pa.RecordBatch:
        n = run.num_rows
        of = lambda c, kind: np.frombuffer(b"".join(run.column(c).to_pylist()), kind).reshape(n, -1)
        links, root = judge(run.column("pivot")[0].as_py(), of("x", "f8"), of("lists", "i4"), run.column("n").to_numpy(), run.column("chunk").to_numpy(), cosine, posted, shared)
        ids = run.column("class").to_numpy()
        found = (links > 0) | (root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(links[found]), pa.array(ids[root][found])], ["class", "links", "root"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of equal keys among sorted rows, each whole; the last one of a batch waits for the next."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if keys[a] != last and held:
                    if sum(x.num_rows for x in held) > 1:
                        yield told(pa.Table.from_batches(held))
                    held = []
                last = keys[a]
                held.append(batch.slice(a, b - a))
        if held and sum(x.num_rows for x in held) > 1:
            yield told(pa.Table.from_batches(held))

    key = ["label", "dim", "pivot", "lo", "hi"]
    sorted_posts = met.select(*key, "chunk", "class", "n", "lists", "x").repartition(*key).sortWithinPartitions(*key, "class")
    part = cut(sorted_posts.mapInArrow(judged, "class long, links long, root long"))
    links = part.groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected(part.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "first", "n").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))  # cut, so that what joins it by one large component can be split
    named = cut(named.join(broadcast_if_small(least), "root").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    linked = rows.filter("v IS NOT NULL").select("vec_id", F.xxhash64("label", "v").alias("class")).join(broadcast_if_small(named), "class").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
