"""Drawing vector documents and comparing them with their source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import fill
from rasterloom.operators.batch import settings
from rasterloom.plans import registry, scoring
from rasterloom.plans.trace import trace, trace_image
from rasterloom.sources import rasters


def test_fill_covers_areas_exactly_along_rows():
    square = fill.coverage(fill.rings("M1.25 1L3.5 1L3.5 3L1.25 3Z"), 5, 4)
    assert np.allclose(square[1], [0, 0.75, 1, 0.5, 0]) and square.sum() == pytest.approx(2.25 * 2)
    ring = fill.coverage(fill.rings("M0 0l8 0l0 8l-8 0zM2 2l4 0l0 4l-4 0z"), 8, 8)
    assert ring[4].tolist() == [1, 1, 0, 0, 0, 0, 1, 1] and ring.sum() == 64 - 16
    k = 4 * (2**0.5 - 1) / 3 * 10
    disc = f"M30 20C30 {20 + k} {20 + k} 30 20 30C{20 - k} 30 10 {20 + k} 10 20C10 {20 - k} {20 - k} 10 20 10C{20 + k} 10 30 {20 - k} 30 20z"
    assert fill.coverage(fill.rings(disc), 40, 40).sum() == pytest.approx(np.pi * 100, rel=0.01)
    outside = fill.coverage(fill.rings("M-5 -5L50 -5L50 50L-5 50Z"), 6, 3)
    assert outside.shape == (3, 6) and (outside == 1).all() and fill.rings("") == []


def test_paint_order_opacity_and_bad_documents():
    svg = '<svg><path fill="#FF0000" d="M0 0L2 0L2 2L0 2z"/><path fill="#0000FF" fill-opacity="0.5" d="M1 0L2 0L2 2L1 2z"/></svg>'
    assert fill.render(svg, 3, 2)[0].tolist() == [[255, 0, 0, 255], [128, 0, 128, 255], [0, 0, 0, 0]]
    for bad in ('<path fill="url(#g)" d="M0 0z"/>', '<path d="M0 0A1 1"/>', '<path d="M0 0c1 2 3"/>'):
        with pytest.raises(ValueError):
            fill.render(bad, 2, 2)


def test_a_trace_lies_where_its_pixels_do():
    square = np.zeros((32, 32, 4), np.uint8)
    square[8:24, 6:26] = (200, 30, 30, 255)
    svg, areas, _ = trace_image(square, settings("icon", "balanced", None))
    again = fill.render(svg, 32, 32)[..., 3] / 255.0
    y, x = np.indices(again.shape)
    assert areas == 1 and again.sum() == pytest.approx(16 * 20, rel=0.05)
    assert (again * (x + 0.5)).sum() / again.sum() == pytest.approx(16, abs=0.1) and (again * (y + 0.5)).sum() / again.sum() == pytest.approx(16, abs=0.1)


def test_traces_are_like_their_source(spark):
    got = {r.image_id: r for r in registry.queries()["trace_scores"](spark, "").collect()}
    assert len(got) == 4 and got[1].similarity > 0.9 and got[1].edges > 0.9
    drawn = rasters.procedural(spark, 16)
    none = trace(drawn, overrides={}).withColumn("svg", F.lit(None).cast("string"))
    assert {(r.similarity, r.edges) for r in scoring.scores(drawn, none).collect()} == {(None, None)}
    assert scoring.draw(none).count() == 0
