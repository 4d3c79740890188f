"""Writers of documents and reports."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import cap_size


def write_documents(documents: DataFrame, folder: str, name: str = "image_id", content: str = "svg") -> DataFrame:
    """Writes each document as <name>.svg into a folder that executors reach by a pyarrow file system; destination and bytes of each.

    Two rows with one name would overwrite each other: they are not written, and their error says so.
    """
    rivals = documents.groupBy(F.col(name).cast("string").alias("__name")).agg(F.count("*").alias("__n"))
    named = documents.select(F.col(name).cast("string").alias("__name"), F.col(content).alias("__content")).join(rivals, "__name")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            rows = []
            for one, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = f"{base}/{one}.svg"
                if n > 1 or text is None:
                    rows.append((to, None, "name taken by several rows" if n > 1 else "no document"))
                    continue
                part = f"{base}/.{one}.{TaskContext.get().taskAttemptId()}"
                data = text.encode()
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, to)
                rows.append((to, len(data), None))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["destination", "svg_bytes", "error"])

    return named.mapInArrow(write, "destination string, svg_bytes long, error string")


def png(r: np.ndarray) -> bytes:
    """A raster (rows, columns, 4) as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((r.shape[0], 1), np.uint8), r.reshape(r.shape[0], -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", r.shape[1], r.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def thumbnails(pixels: DataFrame, max_edge: int = 96) -> DataFrame:
    """image_id and a data URL of each image, made smaller; an empty one where that fails."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            r = np.zeros((frame["y"].max() + 1, frame["x"].max() + 1, 4), np.uint8)
            r[frame["y"], frame["x"]] = frame[["r", "g", "b", "a"]].to_numpy()
            url = "data:image/png;base64," + base64.b64encode(png(cap_size(r, max_edge))).decode()
        except (ValueError, IndexError):
            url = ""
        return pd.DataFrame({"image_id": [int(key[0])], "url": [url]})

    return pixels.select("image_id", "y", "x", "r", "g", "b", "a").groupBy("image_id").applyInPandas(one, "image_id long, url string")


def json_lines(results: DataFrame) -> DataFrame:
    """A line of JSON for each result, without its document."""
    return results.select(F.to_json(F.struct(*(c for c in results.columns if c != "svg"))).alias("line"))


def json_report(results: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """One row of JSON with the results that were converted and those that failed, without their documents: for batches of at most most_rows; see json_lines for larger ones."""
    if results.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} results do not belong into one row; write json_lines")
    row = F.struct(*(c for c in results.columns if c != "svg"))
    lists = results.agg(F.array_sort(F.collect_list(F.when(F.col("ok"), row))).alias("converted"), F.array_sort(F.collect_list(F.when(~F.col("ok"), row))).alias("failed"))
    return lists.select(F.to_json(F.struct("converted", "failed")).alias("report"))
