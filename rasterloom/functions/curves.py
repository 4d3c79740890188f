"""Cubic curves through closed rings of points."""

from __future__ import annotations

import numpy as np


def _unit(v: np.ndarray) -> np.ndarray:
    size = float(np.hypot(*v))
    return v / size if size > 1e-12 else np.zeros(2)


def smooth(points: np.ndarray, passes: int, pinned: set[int] = frozenset()) -> np.ndarray:
    """Weights 1/4, 1/2, 1/4 going round; pinned points and those beside them stay."""
    if len(points) < 5:
        return points
    hold = np.zeros(len(points), bool)
    for p in pinned:
        hold[[p - 1, p, (p + 1) % len(points)]] = True
    for _ in range(passes):
        moved = np.roll(points, 1, 0) * 0.25 + points * 0.5 + np.roll(points, -1, 0) * 0.25
        points = np.where(hold[:, None], points, moved)
    return points


def corners(points: np.ndarray, span: int, degrees: float = 62.0) -> list[int]:
    """Points at which the way turns by more than degrees over span points, the sharpest of those within span."""
    n = len(points)
    if n < max(8, 3 * span):
        return []
    back, ahead = points - np.roll(points, span, 0), np.roll(points, -span, 0) - points
    size = np.hypot(*back.T) * np.hypot(*ahead.T)
    turn = np.degrees(np.arccos(np.clip((back * ahead).sum(1) / np.where(size > 0, size, 1), -1, 1)))
    found: list[int] = []
    for i in np.argsort(-turn, kind="stable"):
        if turn[i] <= degrees:
            break
        if all(min(abs(i - j), n - abs(i - j)) > span for j in found):
            found.append(int(i))
    return sorted(found)


def bezier(control: np.ndarray, t: np.ndarray) -> np.ndarray:
    u = 1 - t
    out = np.empty((len(t), 4))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t
    return out @ control


def _one(points: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The cubic with given ends and end directions that is nearest in squares."""
    u = 1 - t
    b1, b2 = 3 * u * u * t, 3 * u * t * t
    fixed = np.outer(u**3 + b1, points[0]) + np.outer(b2 + t**3, points[-1])
    rows = np.stack([np.outer(b1, start).ravel(), np.outer(b2, end).ravel()], 1)
    gram, right = rows.T @ rows, rows.T @ (points - fixed).ravel()
    chord = float(np.hypot(*(points[-1] - points[0])))
    det = gram[0, 0] * gram[1, 1] - gram[0, 1] * gram[1, 0]
    reach = np.array([right[0] * gram[1, 1] - right[1] * gram[0, 1], right[1] * gram[0, 0] - right[0] * gram[1, 0]]) / det if det > 1e-12 else np.full(2, chord / 3)
    if (reach < 1e-6 * max(chord, 1e-12)).any():
        reach = np.full(2, chord / 3)
    return np.stack([points[0], points[0] + start * reach[0], points[-1] + end * reach[1], points[-1]])


def _closer(points: np.ndarray, control: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One Newton step of each point's parameter."""
    first = 3 * np.diff(control, axis=0)
    second = 2 * np.diff(first, axis=0)
    u = 1 - t
    off = bezier(control, t) - points
    d1 = np.stack([u * u, 2 * u * t, t * t], 1) @ first
    d2 = np.stack([u, t], 1) @ second
    slope = (d1 * d1).sum(1) + (off * d2).sum(1)
    return np.clip(t - np.where(np.abs(slope) > 1e-12, (off * d1).sum(1) / np.where(slope == 0, 1, slope), 0), 0, 1)


def _direction(points: np.ndarray) -> np.ndarray:
    steps = points[1:5] - points[0]
    return _unit((steps / np.arange(1, len(steps) + 1)[:, None]).sum(0))


def fit_open(points: np.ndarray, tolerance: float, start: np.ndarray | None = None, end: np.ndarray | None = None, most_depth: int = 24) -> list[np.ndarray]:
    """Cubics along points, none farther than tolerance from any; a part that will not fit is split where it is worst."""
    out, todo = [], [(points, _direction(points) if start is None else start, _direction(points[::-1]) if end is None else end, 0)]
    while todo:
        part, s, e, depth = todo.pop()
        if len(part) == 2:
            out.append(np.linspace(part[0], part[1], 4))
            continue
        t = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(part, axis=0).T))])
        t = t / t[-1] if t[-1] > 0 else np.linspace(0, 1, len(part))
        for _ in range(12):
            control = _one(part, t, s, e)
            off = np.hypot(*(bezier(control, t) - part).T)
            if off.max() < tolerance or off.max() > 6 * tolerance + 2:
                break
            t = _closer(part, control, t)
        if off.max() < tolerance or depth >= most_depth:
            out.append(control)
            continue
        k = int(np.clip(off.argmax(), 1, len(part) - 2))
        across = _unit(part[max(0, k - 2)] - part[min(len(part) - 1, k + 2)])
        todo += [(part[k:], -across, e, depth + 1), (part[: k + 1], s, across, depth + 1)]
    return out


def fit_closed(points: np.ndarray, tolerance: float, span: int = 3, degrees: float = 62.0, passes: int = 4) -> list[np.ndarray]:
    """Cubics round a ring: sharp turns stay sharp, and without one the seam is smooth."""
    keep = np.hypot(*(points - np.roll(points, 1, 0)).T) > 1e-9
    points = points[keep] if keep.sum() > 2 else points
    points = smooth(points, passes, set(corners(points, span, degrees)))
    sharp = corners(points, span, degrees)
    if not sharp:
        across = _unit(points[1] - points[-1])
        return fit_open(np.vstack([points, points[:1]]), tolerance, across, -across)
    round_ = np.vstack([np.roll(points, -sharp[0], 0), points[sharp[0]]])
    cuts = [s - sharp[0] for s in sharp] + [len(points)]
    return [c for i, j in zip(cuts[:-1], cuts[1:], strict=True) for c in fit_open(round_[i : j + 1], tolerance)]


def number(value: float, precision: int = 1) -> str:
    text = f"{value:.{precision}f}".rstrip("0").rstrip(".") if precision else f"{value:.0f}"
    text = text.replace("0.", ".", 1) if text.startswith(("0.", "-0.")) else text
    return "0" if text in ("", "-", "-0") else text


def path_data(segments: list[np.ndarray], precision: int = 1) -> str:
    """M, c and z with offsets from the rounded pen, so that rounding does not add up."""
    if not segments:
        return ""
    pen = np.round(segments[0][0], precision)
    tokens = ["M", number(pen[0], precision), number(pen[1], precision)]
    for s in segments:
        step = np.round(s[1:] - pen, precision)
        tokens += ["c", *(number(v, precision) for v in step.ravel())]
        pen = np.round(pen + step[-1], precision)
    out = ""
    for t in [*tokens, "z"]:
        apart = out and not out[-1].isalpha() and not t.isalpha() and not t.startswith("-") and not (t.startswith(".") and "." in out.rsplit(" ", 1)[-1].rsplit("-", 1)[-1].rsplit("c", 1)[-1])
        out += " " * bool(apart) + t
    return out
