"""Paints, content, areas and merging of one raster, and the tracer that uses them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import content, fill, kernels, paints, segments
from rasterloom.operators import analysis, neighbourhood, resample
from rasterloom.operators.batch import settings
from rasterloom.plans import trace as tracing
from rasterloom.sources import rasters, sinks

ICON = settings("icon")


def raster(h, w, colour=(255, 255, 255), alpha=255):
    out = np.empty((h, w, 4), np.uint8)
    out[..., :3], out[..., 3] = colour, alpha
    return out


def grid(n):
    return np.mgrid[:n, :n].astype(float)


def test_ramps_are_recovered():
    y, x = grid(40)
    points = np.column_stack([x.ravel() + 0.5, y.ravel() + 0.5])
    alpha = np.ones(len(points))
    t = (points @ [0.6, 0.8]) / 60
    linear, missed = paints.fit(points, np.column_stack([255 * t, 200 - 100 * t, np.full(len(t), 30.0)]), alpha, ICON)
    assert linear.kind == "linear" and missed < 1.5 and len(linear.stops) == 2
    way = np.array(linear.shape[2:]) - linear.shape[:2]
    assert abs(abs(way @ [0.6, 0.8]) / np.hypot(*way) - 1) < 1e-3
    d = np.hypot(*(points - [22, 17]).T)
    radial, missed = paints.fit(points, np.column_stack([255 - 5 * d, 60 + 2 * d, 3 * d]), alpha, ICON)
    assert radial.kind == "radial" and missed < 3 and np.hypot(radial.shape[0] - 22, radial.shape[1] - 17) < 2
    flat, missed = paints.fit(points, np.full((len(points), 3), 77.0), alpha, ICON)
    assert flat.kind == "flat" and missed == 0 and paints.fit(points, np.column_stack([255 * t] * 3), alpha, ICON, flat_only=True)[0].kind == "flat"
    assert paints.fit(points, np.full((len(points), 3), 77.0), t, ICON)[0].kind == "linear"  # alpha alone may ramp
    assert paints.residual(paints.Paint("linear", linear.stops, (3, 3, 3, 3)), points, np.zeros((len(points), 3)), alpha, 90) == float("inf")


def test_stops_are_pruned_and_written():
    line = [(k / 4, (60.0 * k, 10.0, 10.0), 1.0) for k in range(5)]
    assert paints.prune(line, 1.4) == [line[0], line[-1]]
    bent = [*line[:2], (0.5, (250.0, 10.0, 10.0), 1.0), *line[3:]]
    assert len(paints.prune(bent, 1.4)) > 2
    ramp = paints.Paint("radial", ((0.0, (255, 0, 0.5), 1.0), (1.0, (0, 0, 255), 0.5)), (10, 10.25, 8))
    text = paints.definition(ramp, "g1")
    assert text == '<radialGradient id="g1" gradientUnits="userSpaceOnUse" cx="10" cy="10.25" r="8"><stop offset="0" stop-color="#FF0000"/><stop offset="1" stop-color="#0000FF" stop-opacity="0.5"/></radialGradient>'
    back = fill.ramps(text)["g1"]
    assert back.shape == (10, 10.25, 8) and back.stops[1] == (1.0, (0.0, 0.0, 255.0), 0.5)
    flat = paints.Paint("flat", ((0.0, (1, 2, 3), 0.5),))
    assert paints.definition(flat, "g") is None and paints.attributes(flat, "g") == 'fill="#010203" fill-opacity="0.5"' and paints.attributes(ramp, "g") == 'fill="url(#g)"'


def test_numpy_and_relational_operators_agree(spark):
    grids = rasters.procedural(spark, 48).cache()
    frame = grids.toPandas()
    figures = {r.image_id: r for r in analysis.analyze(grids).collect()}
    smaller = resample.cap_size(grids, 30).toPandas()
    softer = neighbourhood.median_rgb(grids).toPandas()
    for k, part in frame.groupby("image_id"):
        lay = lambda f: pd.concat([f]).sort_values(["y", "x"])[list("rgba")].to_numpy().reshape(f.y.max() + 1, f.x.max() + 1, 4)
        r = lay(part).astype(np.uint8)
        found = content.analyze(r)
        assert all(abs(found[n] - getattr(figures[k], n)) < 1e-6 for n in ("texture", "spread", "flatness", "confidence")) and found["kind"] == figures[k].kind and found["samples"] == figures[k].samples
        assert (content.cap_size(r, 30) == lay(smaller[smaller.image_id == k])).all() and (content.denoise(r) == lay(softer[softer.image_id == k])).all()


def test_areas_against_a_flood():
    rng = np.random.default_rng(0)
    for _ in range(60):
        g = rng.integers(0, 3, (rng.integers(1, 12), rng.integers(1, 12)))
        want, k = np.zeros(g.shape, int), 0
        for start in zip(*np.nonzero(g), strict=True):
            if want[start]:
                continue
            k += 1
            todo = [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < g.shape[0] and 0 <= x < g.shape[1] and g[y, x] == g[start] and not want[y, x]:
                    want[y, x] = k
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert (kernels.label4(g) == want).all()


def test_backdrop_goes_only_behind_its_guards():
    logo = raster(80, 80)
    logo[20:60, 20:60, :3] = (200, 0, 0)
    logo[35:45, 35:45, :3] = 255
    cleared, done = content.drop_backdrop(logo)
    assert done and cleared[0, 0, 3] == 0 and cleared[40, 40, 3] == 255 and cleared[30, 30, 3] == 255
    rng = np.random.default_rng(3)
    busy = rng.integers(0, 256, (60, 60, 4)).astype(np.uint8)
    assert not content.drop_backdrop(busy)[1]
    sky = raster(200, 200, (5, 5, 20))
    sky[rng.integers(2, 198, 900), rng.integers(2, 198, 900), :3] = 255
    assert not content.drop_backdrop(sky)[1] and not content.drop_backdrop(raster(50, 50))[1]


def test_absorption_by_worth_within_a_budget():
    parts = np.repeat(np.arange(1, 7), 20)[None].repeat(10, 0)
    colours = np.array([0, 10, 100, 104, 200, 255.0])[parts - 1][..., None].repeat(3, -1)
    assert (segments.absorb(parts, colours, 0, 6) == parts).all()
    fewer = segments.within_budget(parts, colours, 0, 3)
    assert len(np.unique(fewer)) <= 3 and fewer[0, 45] == fewer[0, 65]
    speck = parts.copy()
    speck[4, 5] = 9
    assert (segments.absorb(speck, colours, 8) == parts).all()


def test_soft_edges_go_back_to_their_shapes():
    ramp = np.clip((np.arange(60) - 26) / 8, 0, 1)
    values = (ramp * 230 + 20)[None].repeat(60, 0)
    features = np.stack([values] * 3, -1)
    parts = kernels.label4(np.digitize(values, [40, 90, 140, 190, 230]) + 1).astype(np.int64)
    assert len(np.unique(parts)) > 3
    back = segments.reassign_blends(parts, features, 2)
    assert len(np.unique(back)) == 2 and 28 <= int((back[30] == back[30, 0]).sum()) <= 32
    line = raster(60, 60)[..., :3].astype(float)
    line[:, 29:31] = 0
    strokes = kernels.label4((line[..., 0] > 0) + 1).astype(np.int64)
    assert (segments.reassign_blends(strokes, line, 2) == strokes).all()


def test_merging_is_gradual_and_keeps_every_pixel():
    y, x = grid(60)
    rgb = np.stack([x * 4, np.full_like(x, 90), 255 - x * 4], -1)
    parts = kernels.label4((x // 10).astype(np.int64) + 1).astype(np.int64)
    options = settings("icon", overrides={"min_regions": 1})
    counts = []
    for _, regions in segments.merge(parts, rgb, np.ones(parts.shape), 1, options, [0.0, 0.8, 50.0]):
        assert sorted(np.concatenate([r.pixels for r in regions]).tolist()) == list(range(3600))
        counts.append(len(regions))
    assert counts == sorted(counts, reverse=True) and counts[1] == 1


def drawn(r, **overrides):
    svg, regions, _ = tracing.trace_image(r, settings("icon", overrides=overrides))
    return svg, regions, fill.render(svg, r.shape[1], r.shape[0])


def test_shaded_drawings_become_ramps():
    y, x = grid(96)
    d = np.hypot(x - 48, y - 48)
    disc = np.dstack([255 - 3 * d, np.full_like(d, 60), 3 * d, np.where(d < 44, 255, 0)]).clip(0, 255).astype(np.uint8)
    svg, regions, again = drawn(disc)
    inside = d < 40
    assert "Gradient" in svg and regions <= 4 and np.abs(again[inside].astype(float) - disc[inside]).mean() < 6
    ramp = np.dstack([x * 2.6, np.full_like(x, 80), 255 - x * 2.6, np.full_like(x, 255)]).clip(0, 255).astype(np.uint8)
    svg, regions, again = drawn(ramp)
    assert svg.count("<linearGradient") >= 1 and regions <= 2 and np.abs(again[4:-4, 4:-4].astype(float) - ramp[4:-4, 4:-4]).mean() < 4


def test_marks_survive_and_halos_go():
    mark = raster(160, 160, (235, 235, 235))
    mark[60:90, 70:78, :3] = (30, 30, 30)
    assert drawn(mark)[1] == 2
    y, x = grid(96)
    d = np.hypot(x - 48, y - 48)
    halo = np.dstack([np.full_like(d, 220), np.zeros_like(d), np.zeros_like(d), np.where(d < 30, 255, np.where(d < 44, 12, 0))]).astype(np.uint8)
    again = drawn(halo)[2]
    assert again[48, 48, 3] == 255 and again[48, 48 + 37, 3] == 0
    assert tracing.trace_image(raster(48, 48, alpha=0), ICON)[1] == 0


def test_paths_of_one_fill_share_an_element():
    a, b = ('fill="#111111"', "M1", (0, 0, 5, 5), True), ('fill="#222222"', "M2", (20, 20, 30, 30), True)
    c, over = ('fill="#111111"', "M3", (10, 0, 15, 5), True), ('fill="#333333"', "M4", (9, 0, 16, 6), False)
    assert tracing._coalesced([a, b, c]) == [(a[0], "M1M3"), (b[0], "M2")]
    assert [x[1] for x in tracing._coalesced([a, over, c])] == ["M1", "M4", "M3"]


def test_batches_report_and_name_the_failing_stage(spark, monkeypatch):
    pixels = rasters.procedural(spark, 32)
    rows = {r.image_id: r for r in tracing.trace(pixels, "auto", background="auto").collect()}
    assert all(r.ok and r.preset == r.kind and r.stage is None and r.nodes > 0 for r in rows.values()) and rows[0].gradients >= 1
    done = tracing.trace(pixels, "icon", max_edge=16)
    assert {(r.width, r.height) for r in done.collect()} == {(16, 16)} and "the image was reduced" in done.first().warnings
    variants = tracing.trace(pixels.filter("image_id = 2"), thresholds=[0.1, 5.0]).orderBy("threshold").collect()
    assert [r.threshold for r in variants] == [0.1, 5.0] and variants[0].regions >= variants[1].regions
    bad = tracing.trace(pixels.withColumn("r", F.when(F.col("image_id") == 1, F.lit(None)).otherwise(F.col("r"))), "icon", overrides={"init_clusters": None})
    failed = {r.image_id: r for r in bad.collect()}
    assert not failed[1].ok and failed[1].stage == "load" and failed[0].ok
    assert tracing.exit_status(bad) == 1 and tracing.exit_status(done) == 0 and tracing.exit_status(done.limit(0)) == 2
    assert tracing.single_report(failed[1])[0][0] == "failed" and dict(tracing.single_report(failed[0]))["regions"]
    assert [r.image_id for r in tracing.batch_table(bad).collect()] == [0, 1, 2, 3] and sinks.json_lines(done).count() == 4
    with pytest.raises(ValueError, match="auto, keep, remove"):
        tracing.trace(pixels, background="blue")
    with pytest.raises(ValueError, match="10"):
        sinks.json_report(pixels.withColumn("ok", F.lit(True)), most_rows=10)


def test_noise_is_traced_in_bounded_time():
    rng = np.random.default_rng(5)
    y, x = grid(96)
    base = 128 + 80 * np.sin(x / 17)
    noise = np.dstack([np.clip(base + rng.normal(0, 30, base.shape), 0, 255) for _ in range(3)] + [np.full_like(x, 255)]).astype(np.uint8)
    small, preset, options, found, notes = tracing.prepared(noise, "auto", "balanced", None, 1024, "keep")
    _, svg, regions, _, _ = next(tracing.documents(small, options, [options["merge_tolerance"]]))
    assert preset == found["kind"] == "photo" and regions >= 24 and svg.endswith("</svg>") and content.summary(found).startswith("photo")
