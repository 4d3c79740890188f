"""Connected components by alternating star contractions, in joins and aggregations; what few edges are left is settled in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

HUB_DEGREE = 200_000
#: Edges, of two numbers each, that one task settles; more are contracted by all tasks until there are no more than that.
FEW_EDGES = 200_000


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of at most FEW_EDGES edges (u, v), u > v: every node points at the least one it can reach so far, and pointers are followed and joined until nothing changes."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        nodes, at = np.unique(np.concatenate([rows.column(0).to_numpy(), rows.column(1).to_numpy()]), return_inverse=True)
        a, b = at[: len(rows)], at[len(rows) :]
        root = np.arange(len(nodes))
        while len(a):
            ra, rb = root[a], root[b]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(told, "node long, root long")


def _with_least(edges: DataFrame, hub_degree: int, rows: int) -> DataFrame:
    """edges (u, v), at most rows of them, with m, the least of u and its neighbours. The few nodes of very high degree are sent to the edges, so that none fills a task."""
    least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), rows)
    hubs = least.filter(F.col("n") > hub_degree).select("u", F.col("m").alias("hub_m"))
    if hubs.isEmpty():
        return edges.join(least.drop("n"), "u")
    marked = edges.join(broadcast_if_small(hubs), "u", "left")
    rest = marked.filter("hub_m IS NULL").drop("hub_m").join(least.filter(F.col("n") <= hub_degree).drop("n"), "u")
    return rest.unionByName(marked.filter("hub_m IS NOT NULL").withColumnRenamed("hub_m", "m"))


def connected(edges: DataFrame, a: str = "a", b: str = "b", hub_degree: int = HUB_DEGREE, most_rounds: int = 60, most_edges: int | None = None, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node with a larger-than-root id: root is the smallest node of its component, which itself has no row.

    Each round is a large-star and a small-star step, with its rows cut to the checkpoint folder; the rows of a round
    are at most the edges of the one before. Nulls link with nothing. The number of rounds is logarithmic in practice.
    At most few_edges edges, of integers, are settled by one task, which holds them in arrays.
    most_edges: a bound on their number, if one is known.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), most_edges)
    state = None
    for _ in range(most_rounds):
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if new[0] <= few_edges and now.schema["u"].dataType.simpleString() == "bigint":
            return cut(_settled(now), new[0])
        state, rows = new, 2 * new[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_least(both, hub_degree, rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows)
        stars = _with_least(large, hub_degree, rows)
        small = stars.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        now = cut(small.filter("u <> v").distinct(), 2 * rows)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
