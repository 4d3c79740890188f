"""Contours, curves and whole documents."""

import re

import numpy as np

from rasterloom.functions import curves, kernels, segments
from rasterloom.plans.trace import trace
from rasterloom.sources.rasters import procedural


def test_contours_go_round_and_keep_corner_pixels_apart():
    mask = np.zeros((6, 6), bool)
    mask[1:3, 1:3] = mask[3:5, 3:5] = True
    rings = kernels.contours(mask)
    assert len(rings) == 2
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert len(kernels.contours(ring)) == 2 and kernels.contours(np.zeros((3, 3), bool)) == []


def test_square_and_circle_need_few_segments():
    mask = np.zeros((60, 60), bool)
    mask[10:50, 10:50] = True
    square = curves.fit_closed(kernels.contours(mask)[0], 0.4)
    y, x = np.mgrid[:120, :120]
    (ring,) = kernels.contours((x - 60) ** 2 + (y - 60) ** 2 < 45**2)
    circle = curves.fit_closed(ring, 0.4)
    assert len(square) == 4 and 4 <= len(circle) <= 16
    far = np.hypot(*(np.vstack([curves.bezier(c, np.linspace(0, 1, 20)) for c in circle]) - 60).T)
    assert np.abs(far - 45).max() < 1.2


def test_path_text():
    line = np.array([[0, 0], [1, 0], [2, -0.5], [3, 0.0]])
    assert curves.path_data([line]) == "M0 0c1 0 2-.5 3 0z"
    assert curves.number(-0.04) == "0" and curves.number(0.5) == ".5"


def test_kmeans_and_absorption():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 1, (50, 3)) for c in (0, 100, 200)])
    assert sorted(np.round(kernels.kmeans(points, 3).mean(1) / 100).astype(int)) == [0, 1, 2]
    parts = np.ones((5, 5), np.int64)
    parts[2, 2] = 2
    assert (segments.absorb(parts, np.zeros((5, 5, 3)), 3) == 1).all()
    assert kernels.carrying_colors(np.array([[0, 0, 0]] * 50 + [[255, 0, 0]] * 50)) == 2


def test_documents(spark):
    rows = {r.image_id: r for r in trace(procedural(spark, 40)).collect()}
    assert len(rows) == 4 and all(r.ok for r in rows.values())
    flat = rows[1]
    assert flat.regions == 2 and len(re.findall("<path", flat.svg)) == 2 and "#C81E1E" in flat.svg and flat.svg.endswith("</svg>")
