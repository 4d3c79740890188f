"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

A document's ids are cut into pieces of at most ``capacity`` only if there are more; the first piece takes what does
not fill a sequence. The driver sees only the histogram of piece lengths, at most ``capacity`` rows, and plans bins
over it (see bin_plan); each piece then finds its place by its rank among the pieces of its length.

Defined cases: a null text is empty and makes a piece with the end id alone; documents with equal ids are packed each
on its own; equal rows get different places; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bin_plan import plan
from .common import cut
from .tokens import encoder

CAPACITY = 2048
#: Rows in one window of ranks, about.
WINDOW_ROWS = 50_000
#: Bytes of text encoded at once, about.
BLOCK_BYTES = 6_000_000
_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text", cached_chunks: int = 150_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with keep_ids the token ids of each piece. cached_chunks trades a worker's memory, some 500 bytes each, for time."""
    end = int(end_id).to_bytes(4, "little")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cached_chunks).encode
        for batch in batches:
            step = max(1, batch.num_rows * BLOCK_BYTES // max(1, batch.column(1).nbytes))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                of, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "ids")}
                for k, ids in enumerate(encode([t or "" for t in rows.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    for number, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if number == 0 else capacity
                        part = ids[4 * start : 4 * (start + length)]
                        of.append(k)
                        for name, value in (("piece", number), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(part))):
                            out[name].append(value)
                        if keep_ids:
                            out["ids"].append(np.frombuffer(part, "<i4"))
                cols = [rows.column(0).take(pa.array(of, pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(split, f"doc_id {kind}, {_PIECE}" + ", ids array<int>" * keep_ids)


class Places:
    """Where the r-th piece of a length goes. Its size follows from the number of lengths, not of pieces."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        self.bins = sum(m for _, m in bins)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        first = 0
        for sizes, m in bins:
            offset = 0
            for w in sizes:
                slots.setdefault(w, []).append((ranks.get(w, 0), first, offset))
                ranks[w] = ranks.get(w, 0) + m
                offset += w
            first += m
        self.slots = {w: np.array(x, np.int64) for w, x in slots.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, edges) if len(order) else ():
            slots = self.slots[int(lengths[rows[0]])]
            k = np.searchsorted(slots[:, 0], ranks[rows], "right") - 1
            sequence[rows], offset[rows] = slots[k, 1] + ranks[rows] - slots[k, 0], slots[k, 2]
        return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (see pieces) with sequence_id and offset. parts is read more than once: hand in a cut one."""
    counts = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    places = Places(plan(counts, capacity))
    groups = max(1, sum(counts.values()) // WINDOW_ROWS)
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    tally = dealt.groupBy("length", "__group").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("__row", F.row_number().over(within)).join(tally, ["length", "__group"])
    ranked = ranked.select(*parts.columns, (F.col("__before") + F.col("__row") - 1).alias("__rank"))

    names = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, cached_chunks: int = 150_000) -> DataFrame:
    """Every piece of every document with its sequence and place in it."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id, keep_ids, cached_chunks=cached_chunks)), capacity)
