"""Paints of regions: flat colours, and linear and radial ramps fitted by least squares, in NumPy for one region at a time."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: What a fit needs: pixels at least, spread of alpha from which it counts, stops at least.
LEAST_PIXELS, ALPHA_SPREAD, LEAST_STOPS = 16, 0.02, 2
#: The farthest centre of a ring ramp in diagonals of its region, and the alpha below which opacity is written.
FAR_CENTRE, OPAQUE = 2.5, 0.995

Stop = tuple[float, tuple[float, ...], float]


@dataclass(frozen=True)
class Paint:
    """kind: flat, linear (shape x1, y1, x2, y2) or radial (shape cx, cy, radius). stops: offset, colour, alpha from 0 to 1, in order of offset."""

    kind: str
    stops: tuple[Stop, ...]
    shape: tuple[float, ...] = ()


def redmean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted colour distance with weights that follow the mean red."""
    mean = (a[..., 0] + b[..., 0]) / 2
    off = (a - b) ** 2
    return np.sqrt(((2 + mean / 256) * off[..., 0] + 4 * off[..., 1] + (2 + (255 - mean) / 256) * off[..., 2]) / 3)


def offsets(paint: Paint, points: np.ndarray) -> np.ndarray | None:
    """Place of each point along the ramp, 0 to 1; None where the ramp has no length."""
    if paint.kind == "linear":
        start, way = np.array(paint.shape[:2]), np.array(paint.shape[2:]) - paint.shape[:2]
        long = way @ way
        return np.clip((points - start) @ way / long, 0, 1) if long > 0 else None
    cx, cy, radius = paint.shape
    return np.minimum(np.hypot(points[:, 0] - cx, points[:, 1] - cy) / radius, 1) if radius > 0 else None


def colours(paint: Paint, points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Colour and alpha of each point; None for a ramp without length."""
    if paint.kind == "flat":
        return np.broadcast_to(np.array(paint.stops[0][1], float), (len(points), 3)), np.full(len(points), paint.stops[0][2])
    t = offsets(paint, points)
    if t is None:
        return None
    at = [s[0] for s in paint.stops]
    return np.stack([np.interp(t, at, [s[1][c] for s in paint.stops]) for c in range(3)], 1), np.interp(t, at, [s[2] for s in paint.stops])


def residual(paint: Paint, points: np.ndarray, rgb: np.ndarray, alpha: np.ndarray, alpha_weight: float) -> float:
    """Mean distance of the colours from the paint and the weighted mean error of alpha; infinite for a ramp without length."""
    found = colours(paint, points)
    if found is None:
        return float("inf")
    return float(redmean(found[0], rgb).mean() + alpha_weight * np.abs(found[1] - alpha).mean())


def _beyond(near: Stop, far: Stop, to: float) -> Stop:
    """The stop at to in line with the two nearest ones, within the range of colours."""
    gap = near[0] - far[0]
    by = (to - near[0]) / gap if gap else 0.0
    colour = tuple(float(np.clip(n + (n - f) * by, 0, 255)) for n, f in zip(near[1], far[1], strict=True))
    return to, colour, float(np.clip(near[2] + (near[2] - far[2]) * by, 0, 1))


def stops_along(t: np.ndarray, rgb: np.ndarray, alpha: np.ndarray, count: int, low: float, high: float) -> list[Stop]:
    """Means of quantile bins as stops from 0 to 1, gone on in line to both ends."""
    edges = np.quantile(t, np.linspace(0, 1, count + 1))
    bins = np.clip(np.searchsorted(edges, t, "right") - 1, 0, count - 1)
    n = np.bincount(bins, minlength=count)
    total = lambda v: np.bincount(bins, v, count) / np.maximum(n, 1)
    at, mean, opacity = total(t), np.stack([total(rgb[:, c]) for c in range(3)], 1), total(alpha)
    out: list[Stop] = []
    for k in np.flatnonzero(n >= 2):
        if not out or at[k] > out[-1][0]:
            out.append((float(at[k]), tuple(mean[k].tolist()), float(opacity[k])))
    if len(out) >= 2:
        if out[0][0] > low:
            out.insert(0, _beyond(out[0], out[1], low))
        if out[-1][0] < high:
            out.append(_beyond(out[-1], out[-2], high))
    return [((o - low) / (high - low), c, a) for o, c, a in out]


def prune(stops: list[Stop], tolerance: float) -> list[Stop]:
    """stops without the inner ones that the line between their neighbours replaces within tolerance, the least missed first."""
    stops = list(stops)
    while len(stops) > 2:
        missed = []
        for before, here, after in zip(stops, stops[1:], stops[2:], strict=False):
            by = (here[0] - before[0]) / (after[0] - before[0])
            line = lambda a, b: np.array(a) + (np.array(b) - a) * by  # noqa: E731,B023
            missed.append(float(redmean(line(before[1], after[1]), np.array(here[1]))) + 255 * abs(float(line(before[2], after[2])) - here[2]))
        k = int(np.argmin(missed))
        if missed[k] > tolerance:
            break
        del stops[k + 1]
    return stops


def _signal(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.column_stack([rgb, alpha * 255]) if np.ptp(alpha) >= ALPHA_SPREAD else rgb


def _linear(points: np.ndarray, signal: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Where a plane through each channel rises most on the whole: a point and a direction."""
    middle = points.mean(0)
    slopes, *_ = np.linalg.lstsq(points - middle, signal - signal.mean(0), rcond=None)
    if np.abs(slopes).max() < 1e-9:
        return None
    values, vectors = np.linalg.eigh(slopes @ slopes.T)
    return middle, vectors[:, int(values.argmax())]


def _radial(points: np.ndarray, signal: np.ndarray) -> np.ndarray | None:
    """The centre that the channels' paraboloids share, weighted by their curvature."""
    base = points.mean(0)
    x, y = (points - base).T
    fitted, *_ = np.linalg.lstsq(np.column_stack([np.ones_like(x), x, y, x * x + y * y]), signal, rcond=None)
    bend = fitted[3]
    weight = (bend * bend).sum()
    return base - (fitted[1:3] * bend).sum(1) / (2 * weight) if weight > 1e-18 else None


def fit(points: np.ndarray, rgb: np.ndarray, alpha: np.ndarray, options: dict, seed: int = 0, flat_only: bool = False) -> tuple[Paint, float]:
    """The paint of a region and its residual: flat unless a ramp is better by the preset's gain."""
    if len(points) > options["fit_sample_limit"]:
        pick = np.random.default_rng(seed).choice(len(points), options["fit_sample_limit"], replace=False)
        points, rgb, alpha = points[pick], rgb[pick], alpha[pick]
    weight = options["alpha_residual_weight"]
    flat = Paint("flat", ((0.0, tuple(rgb.mean(0).tolist()), float(alpha.mean())),))
    best, least = flat, residual(flat, points, rgb, alpha, weight)
    if flat_only or least <= options["flat_tolerance"] or len(points) < LEAST_PIXELS:
        return best, least
    limit, signal = least * options["gradient_gain"], _signal(rgb, alpha)
    found: list[Paint] = []
    if line := _linear(points, signal):
        t = (points - line[0]) @ line[1]
        low, high = float(t.min()), float(t.max())
        if high - low > 1e-9:
            ends = (*(line[0] + line[1] * low), *(line[0] + line[1] * high))
            found.append(Paint("linear", tuple(stops_along(t, rgb, alpha, options["gradient_stops"], low, high)), tuple(map(float, ends))))
    centre = _radial(points, signal)
    if centre is not None:
        box = np.stack([points.min(0), points.max(0)])
        t = np.hypot(*(points - centre).T)
        if np.hypot(*(centre - box.mean(0))) <= FAR_CENTRE * np.hypot(*(box[1] - box[0])) and t.max() > 1e-6:
            found.append(Paint("radial", tuple(stops_along(t, rgb, alpha, options["gradient_stops"], 0.0, float(t.max()))), (float(centre[0]), float(centre[1]), float(t.max()))))
    for paint in found:
        if len(paint.stops) >= LEAST_STOPS:
            paint = replace(paint, stops=tuple(prune(list(paint.stops), options["stop_prune_tolerance"])))
            missed = residual(paint, points, rgb, alpha, weight)
            if missed < limit and missed < least:
                best, least = paint, missed
    return best, least


def number(value: float, precision: int = 2) -> str:
    text = f"{value:.{precision}f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def hex_color(colour: tuple[float, ...]) -> str:
    return "#" + "".join(f"{int(np.clip(np.rint(c), 0, 255)):02X}" for c in colour)


def definition(paint: Paint, name: str) -> str | None:
    """The gradient element of a ramp, in the units of the drawing; None for a flat paint."""
    if paint.kind == "flat":
        return None
    keys = ("x1", "y1", "x2", "y2") if paint.kind == "linear" else ("cx", "cy", "r")
    place = "".join(f' {k}="{number(v)}"' for k, v in zip(keys, paint.shape, strict=True))
    stops = "".join(f'<stop offset="{number(o, 3)}" stop-color="{hex_color(c)}"{_opacity("stop", a)}/>' for o, c, a in paint.stops)
    return f'<{paint.kind}Gradient id="{name}" gradientUnits="userSpaceOnUse"{place}>{stops}</{paint.kind}Gradient>'


def _opacity(of: str, alpha: float) -> str:
    return f' {of}-opacity="{number(alpha, 3)}"' if alpha < OPAQUE else ""


def attributes(paint: Paint, name: str) -> str:
    if paint.kind != "flat":
        return f'fill="url(#{name})"'
    return f'fill="{hex_color(paint.stops[0][1])}"' + _opacity("fill", paint.stops[0][2])


#: Products whose sums centre() takes, z being x x + y y.
PAIRS = ("xx", "xy", "yy", "xz", "yz", "zz", *(a + c for a in "xyz" for c in "rgb"))


def centre(sums: dict[str, int]) -> tuple[float, float] | None:
    """The centre that the paraboloids of r, g and b share, from the number of points n and their sums, all whole: x, y, z, r, g, b and PAIRS, of which some may have a part in units of 2**32 under _high.

    Covariances are kept as whole numbers, n * n times as large, so that what is nothing comes out as nothing. None without an area, without a curvature that the points could show, or without one."""
    n = sums["n"]
    v = {p: n * (sums[p] + (sums.get(f"{p}_high", 0) << 32)) - sums[p[0]] * sums[p[1]] for p in PAIRS}
    det = v["xx"] * v["yy"] - v["xy"] ** 2
    if det * 10**9 <= n**4:
        return None
    px, py = v["xz"] * v["yy"] - v["yz"] * v["xy"], v["yz"] * v["xx"] - v["xz"] * v["xy"]
    left = v["zz"] * det - px * v["xz"] - py * v["yz"]
    if left * 10**6 <= det * n**2:
        return None
    bend = {c: v[f"z{c}"] * det - px * v[f"x{c}"] - py * v[f"y{c}"] for c in "rgb"}
    weight = sum(b * b for b in bend.values())
    if weight * 10**9 <= left**2:
        return None
    gx = sum((v[f"x{c}"] * v["yy"] - v[f"y{c}"] * v["xy"]) * b for c, b in bend.items())
    gy = sum((v[f"y{c}"] * v["xx"] - v[f"x{c}"] * v["xy"]) * b for c, b in bend.items())
    return (px * weight - gx * left) / (2 * det * weight), (py * weight - gy * left) / (2 * det * weight)
