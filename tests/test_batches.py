"""Sinks, reports and incremental batches."""

import base64

import numpy as np
from test_operators import png

from rasterloom.plans.trace import trace
from rasterloom.sources import sinks
from rasterloom.sources.rasters import procedural
from rasterloom.sources.sinks import json_report, write_documents
from rasterloom.streaming.ingest import trace_new_files


def test_documents_and_report(spark, tmp_path):
    done = trace(procedural(spark, 24)).cache()
    rows = write_documents(done, f"file://{tmp_path}/out").collect()
    assert len(rows) == 4 and (tmp_path / "out" / "1.svg").read_text().startswith("<svg")
    assert {r.error for r in write_documents(done.union(done), f"file://{tmp_path}/twice").collect()} == {"name taken by several rows"}
    assert '"failed":[]' in json_report(done).first()[0]


def test_only_new_files_are_traced(spark, tmp_path):
    (tmp_path / "in").mkdir()
    art = np.full((20, 20, 3), 240)
    art[5:15, 5:15] = (200, 10, 10)
    png(tmp_path / "in" / "a.png", art)
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    run = lambda: trace_new_files(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "seen")).awaitTermination()
    run()
    png(tmp_path / "in" / "b.png", art)
    run()
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.path[-5:], r.ok) for r in rows) == [("a.png", True), ("b.png", True), ("d.png", False)]
    assert len({r.batch for r in rows}) == 2


def test_headers_tell_orientation_and_alpha(spark, tmp_path):
    from rasterloom.sources import rasters

    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xd9"
    opaque = np.full((2, 2, 3), 9)
    png(tmp_path / "o.png", opaque)
    clear = sinks.png(np.zeros((2, 3, 4), np.uint8))
    rows = [("a.jpg", jpeg), ("b.png", clear), ("c.png", (tmp_path / "o.png").read_bytes()), ("d.gif", b"GIF89a..\x21\xf9\x04\x01.."), ("e.jpg", b"\xff\xd8\xff\xd9"), ("f", None), ("g.jpg", jpeg[:20])]
    got = {r.path: (r.orientation, r.had_alpha) for r in rasters.provenance(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.jpg": (6, False), "b.png": (1, True), "c.png": (1, False), "d.gif": (1, True), "e.jpg": (1, False), "f": (1, False), "g.jpg": (1, False)}


def test_thumbnails_are_small_pictures(spark, tmp_path):
    rows = sinks.thumbnails(procedural(spark, 24), 8).collect()
    assert len(rows) == 4
    (tmp_path / "t").mkdir()
    for r in rows:
        (tmp_path / "t" / f"{r.image_id}.png").write_bytes(base64.b64decode(r.url.split(",", 1)[1]))
    read = spark.read.format("image").load(str(tmp_path / "t")).select("image.*").collect()
    assert {(r.width, r.height, r.nChannels) for r in read} == {(8, 8, 4)}


def test_orientation_turns_pixels(spark):
    from pyspark.sql import functions as F

    from rasterloom.operators.pixels import oriented

    rows = [(0, y, x, 10 * y + x, 0, 0, 255) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    a = np.array([[0, 1, 2], [10, 11, 12]])
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a, 1)}
    for code, upright in want.items():
        got = np.full(upright.shape, -1)
        for r in oriented(df, F.lit(code)).collect():
            got[r.y, r.x] = r.r
        assert (got == upright).all(), code


def test_jobs_can_be_cancelled(spark):
    import threading

    from rasterloom.streaming import ingest

    failed = []

    def slow():
        try:
            with ingest.cancellable(spark, "mine"):
                spark.range(1 << 40).selectExpr("max(id % 7)").collect()
        except Exception as e:  # noqa: BLE001
            failed.append(str(e))

    thread = threading.Thread(target=slow)
    thread.start()
    for _ in range(100):
        ingest.cancel(spark, "mine")
        thread.join(0.3)
        if not thread.is_alive():
            break
    assert failed and "cancel" in failed[0].lower()


def test_rerun_and_selection(spark):
    from rasterloom.operators import batch

    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, options string")
    done = spark.createDataFrame([(1, "a"), (3, "old")], jobs.schema)
    ids = lambda df: sorted(r.id for r in df.collect())
    only = lambda *i: spark.createDataFrame([(k,) for k in i], "id int")
    assert ids(batch.selected(jobs, done, ["id", "options"])) == [2, 3] and ids(batch.selected(jobs, done, ["id", "options"], only(1, 9))) == [1]
    assert ids(batch.selected(jobs, batch.rerun(done, ["id"]), ["id", "options"])) == [1, 2, 3]
    assert ids(batch.selected(jobs, batch.rerun(done, ["id"], only(1)), ["id", "options"])) == [1, 2, 3]
