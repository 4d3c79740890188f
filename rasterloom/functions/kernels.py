"""NumPy kernels for what is sequential within one image."""

from __future__ import annotations

import numpy as np


def label4(grid: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected areas of equal non-zero values, from 1 in raster order of their first pixel; 0 elsewhere.

    Runs of equal values along rows are joined to those they touch below. Every run points at the least run it can reach so far; pointers are
    followed and merged until nothing changes."""
    h, w = grid.shape
    new = np.ones((h, w), bool)
    new[:, 1:] = grid[:, 1:] != grid[:, :-1]
    run = (np.cumsum(new.ravel()) - 1).reshape(h, w)
    value = grid.ravel()[new.ravel()]
    touch = (grid[:-1] == grid[1:]) & (grid[1:] != 0) & (new[:-1] | new[1:])  # runs that touch do so where one of them begins
    a, b = run[:-1][touch], run[1:][touch]
    root = np.arange(len(value))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    number = np.zeros(len(value), np.int32)
    used = value != 0
    _, number[used] = np.unique(root[used], return_inverse=True)
    number[used] += 1
    return number[run]


def kmeans(points: np.ndarray, k: int, rounds: int = 20, seed: int = 12345) -> np.ndarray:
    """Centres by k-means++ seeding and Lloyd's rounds; a centre that loses all points stays where it is."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centres = points[rng.integers(len(points))][None].astype(float)
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        mass = far.sum()
        pick = rng.choice(len(points), p=far / mass) if mass > 0 else rng.integers(len(points))
        centres = np.vstack([centres, points[pick]])
        far = np.minimum(far, ((points - points[pick]) ** 2).sum(1))
    labels = None
    for _ in range(rounds):
        new = nearest(points, centres)
        if labels is not None and (new == labels).all():
            break
        labels = new
        n = np.bincount(labels, minlength=k)
        for c in range(points.shape[1]):
            total = np.bincount(labels, points[:, c], k)
            centres[n > 0, c] = total[n > 0] / n[n > 0]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, block: int = 65_536) -> np.ndarray:
    """Number of each point's nearest centre, the first on ties."""
    out = np.empty(len(points), np.int64)
    half = (centres**2).sum(1) / 2  # half the squared distance, but for what is the same for all centres
    for at in range(0, len(points), block):
        out[at : at + block] = (half - points[at : at + block] @ centres.T).argmin(1)
    return out


def carrying_colors(rgb: np.ndarray, radius: float = 38.0, share: float = 0.97, width: int = 8) -> int:
    """How many balls of a radius, each about the fullest bin not yet covered, hold that share of the colours."""
    if not len(rgb):
        return 0
    side = 256 // width + 1
    q = rgb.astype(np.int64) // width
    every = np.bincount((q[:, 0] * side + q[:, 1]) * side + q[:, 2], minlength=side**3)
    code = np.flatnonzero(every)
    n = every[code]
    middle = np.stack([code // (side * side), code // side % side, code % side], 1) * width + width / 2
    open_, covered, balls = np.ones(len(n), bool), 0, 0
    while covered < share * n.sum():
        at = int(np.where(open_, n, -1).argmax())
        taken = open_ & (((middle - middle[at]) ** 2).sum(1) <= radius * radius)
        covered += int(n[taken].sum())
        open_ &= ~taken
        balls += 1
    return balls


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Closed rings (x, y) half way between the mask and what is outside, the mask on the left; a pixel spans from its number to the next. Where two of its pixels meet only at a corner the rings keep them apart."""
    m = np.pad(mask.astype(bool), 1)
    w = m.shape[1]
    a, b, c, d = m[:-1, :-1], m[:-1, 1:], m[1:, 1:], m[1:, :-1]
    at = np.arange((m.shape[0] - 1) * (w - 1)).reshape(a.shape)
    number = (at // (w - 1)) * w + at % (w - 1)
    top, left, bottom, right = 2 * number, 2 * number + 1, 2 * (number + w), 2 * (number + 1) + 1
    # where a ring enters a cell and where it leaves
    enters = [(b & ~a, top), (a & ~d, left), (d & ~c, bottom), (c & ~b, right)]
    leaves = [(a & ~b, top), (d & ~a, left), (c & ~d, bottom), (b & ~c, right)]
    follow: dict[int, int] = {}
    both = (a & c & ~b & ~d) | (b & d & ~a & ~c)
    start, stop = np.zeros(a.shape, np.int64), np.zeros(a.shape, np.int64)
    for hit, edge in enters:
        start[hit] = edge[hit]
    for hit, edge in leaves:
        stop[hit] = edge[hit]
    plain = (a | b | c | d) & ~(a & b & c & d) & ~both
    follow.update(zip(start[plain].tolist(), stop[plain].tolist(), strict=True))
    for hit, pairs in ((both & a, ((left, top), (right, bottom))), (both & b, ((top, right), (bottom, left)))):
        for one, other in pairs:
            follow.update(zip(one[hit].tolist(), other[hit].tolist(), strict=True))
    rings = []
    while follow:
        first, now = next(iter(follow.items()))
        del follow[first]
        ring = [first]
        while now != first:
            ring.append(now)
            now = follow.pop(now)
        e = np.array(ring)
        y, x = (e // 2) // w, (e // 2) % w
        rings.append(np.stack([x + np.where(e % 2 == 0, 0.5, 0.0) - 0.5, y + np.where(e % 2 == 1, 0.5, 0.0) - 0.5], 1))
    return rings
