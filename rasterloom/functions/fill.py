"""Vector documents back to pixels: even-odd fills, flat or by ramps, with soft edges."""

from __future__ import annotations

import re

import numpy as np

from .curves import bezier
from .paints import Paint, colours

_TOKEN = re.compile(r"[A-Za-z]|-?(?:\d+\.?\d*|\.\d+)")
_PATH = re.compile(r"<path ([^>]*)/>")
_RAMP = re.compile(r"<(linear|radial)Gradient ([^>]*)>(.*?)</\1Gradient>", re.DOTALL)
_STOP = re.compile(r"<stop ([^>]*)/>")
_ATTRIBUTE = re.compile(r'([\w-]+)="([^"]*)"')
#: Scan lines in a row of pixels, and straight pieces of a curve.
LINES, PIECES = 4, 12
_NEED = {"m": 2, "l": 2, "c": 6}


def rings(data: str) -> list[np.ndarray]:
    """Closed polylines of path data made of M, L, C and Z, absolute or relative."""
    tokens = _TOKEN.findall(data)
    out, ring, pen, command, i = [], [], np.zeros(2), "", 0
    start = pen
    t = np.linspace(0, 1, PIECES + 1)[1:]
    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
        kind = command.lower()
        if kind == "z":
            if len(ring) > 2:
                out.append(np.array(ring))
            ring, pen = [], start
            continue
        if kind not in _NEED:
            raise ValueError(f"path command {command!r} is not supported")
        points = np.array(tokens[i : i + _NEED[kind]], float).reshape(-1, 2)
        if 2 * len(points) != _NEED[kind]:
            raise ValueError("path data ends within a command")
        i += _NEED[kind]
        if command.islower():
            points = points + pen
        if kind == "m":
            if len(ring) > 2:
                out.append(np.array(ring))
            ring, start = [points[0]], points[0]
            command = "l" if command == "m" else "L"  # further pairs are lines
        elif kind == "l":
            ring.append(points[0])
        else:
            ring += list(bezier(np.vstack([pen, points]), t))
        pen = points[-1]
    if len(ring) > 2:
        out.append(np.array(ring))
    return out


def coverage(shapes: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """The covered share of each pixel: exact along the row, at LINES lines down it."""
    total = np.zeros((height, width + 2))
    edges = [(ring, np.roll(ring, -1, 0)) for ring in shapes]
    if not edges:
        return total[:, :width]
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    a, b = np.where((a[:, 1] <= b[:, 1])[:, None], a, b), np.where((a[:, 1] <= b[:, 1])[:, None], b, a)
    line = lambda y: np.clip(np.ceil(y * LINES - 0.5), 0, height * LINES).astype(np.int64)
    first, count = line(a[:, 1]), line(b[:, 1]) - line(a[:, 1])
    edge = np.repeat(np.arange(len(a)), count)
    at = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + first[edge]
    share = ((at + 0.5) / LINES - a[edge, 1]) / (b[edge, 1] - a[edge, 1])
    x = np.clip(a[edge, 0] + share * (b[edge, 0] - a[edge, 0]), 0, width)
    order = np.lexsort((x, at))
    x, row = x[order], at[order] // LINES
    sign = np.where(np.arange(len(x)) % 2, -1.0, 1.0) / LINES  # every line is crossed an even number of times
    whole = np.floor(x).astype(np.int64)
    np.add.at(total, (row, whole), sign * (1 - (x - whole)))
    np.add.at(total, (row, whole + 1), sign * (x - whole))
    return np.clip(total.cumsum(1)[:, :width], 0, 1)


def _rgb(text: str) -> tuple[float, ...]:
    if not re.fullmatch("#[0-9A-Fa-f]{6}", text):
        raise ValueError(f"fill {text!r} is not supported")
    return tuple(float(int(text[k : k + 2], 16)) for k in (1, 3, 5))


def ramps(svg: str) -> dict[str, Paint]:
    """The gradient elements of a document by their ids."""
    out = {}
    for kind, head, inner in _RAMP.findall(svg):
        found = dict(_ATTRIBUTE.findall(head))
        shape = tuple(float(found[k]) for k in (("x1", "y1", "x2", "y2") if kind == "linear" else ("cx", "cy", "r")))
        stops = [dict(_ATTRIBUTE.findall(text)) for text in _STOP.findall(inner)]
        out[found["id"]] = Paint(kind, tuple((float(x["offset"]), _rgb(x["stop-color"]), float(x.get("stop-opacity", 1))) for x in stops), shape)
    return out


def render(svg: str, width: int, height: int) -> np.ndarray:
    """Straight-alpha pixels (rows, columns, 4) of a document, painted in order."""
    colour, alpha = np.zeros((height, width, 3)), np.zeros((height, width))
    known = ramps(svg)
    y, x = np.indices((height, width)).reshape(2, -1) + 0.5
    for text in _PATH.findall(svg):
        found = dict(_ATTRIBUTE.findall(text))
        fill = found.get("fill", "#000000")
        part = coverage(rings(found.get("d", "")), width, height) * float(found.get("fill-opacity", 1))
        if fill.startswith("url(#"):
            if fill[5:-1] not in known or (painted := colours(known[fill[5:-1]], np.column_stack([x, y]))) is None:
                raise ValueError(f"fill {fill!r} is not supported")
            own = painted[0].reshape(height, width, 3)
            part = part * painted[1].reshape(height, width)
        else:
            own = np.array(_rgb(fill))
        colour = colour * (1 - part[..., None]) + part[..., None] * own
        alpha = alpha * (1 - part) + part
    straight = colour / np.maximum(alpha, 1e-9)[..., None]
    return np.rint(np.concatenate([np.clip(straight, 0, 255) * (alpha > 0)[..., None], 255 * alpha[..., None]], 2)).astype(np.uint8)
