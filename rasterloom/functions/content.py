"""What one raster holds, in NumPy: resizing, backdrop, content class, Lab colours. The relational operators say the same for whole tables."""

from __future__ import annotations

import math

import numpy as np

from ..operators.analysis import COLOURS, FLATNESS, LEAST_SAMPLES, SPREAD, STEP, TEXTURE
from ..operators.resample import REACH
from .kernels import carrying_colors, label4

#: Deviation up to which a border is uniform, shares of backdrop that are believed, islands at most.
UNIFORM, LEAST_SHARE, MOST_SHARE, MOST_ISLANDS = 12.0, 0.02, 0.97, 32


def kernel(method: str, t: np.ndarray) -> np.ndarray:
    u = np.abs(t)
    if method == "bilinear":
        return np.maximum(0, 1 - u)
    if method == "bicubic":
        return np.where(u < 1, (1.5 * u - 2.5) * u * u + 1, np.where(u < 2, ((-0.5 * u + 2.5) * u - 4) * u + 2, 0))
    return np.where(u < 3, np.sinc(t) * np.sinc(t / 3), 0)


def weights(n_in: int, n_out: int, method: str) -> np.ndarray:
    """What each source place gives to each place: (n_out, n_in). An unknown method is lanczos."""
    method = method if method in REACH else "lanczos"
    scale = n_in / n_out
    centre = (np.arange(n_out)[:, None] + 0.5) * scale
    at = np.arange(n_in)[None]
    if method == "nearest":
        return (at == np.minimum(np.floor(centre), n_in - 1)).astype(float)
    wide = max(scale, 1.0)
    reach = REACH[method] * wide
    inside = (at >= np.floor(centre - reach + 0.5)) & (at < np.floor(centre + reach + 0.5))
    k = kernel(method, (at - centre + 0.5) / wide) * inside
    return k / k.sum(1, keepdims=True)


def resize(r: np.ndarray, width: int, height: int, method: str = "lanczos") -> np.ndarray:
    """Straight-alpha levels (rows, columns, 4) in another size: alpha is multiplied in before and taken out after, levels are rounded after each axis."""
    level = lambda v: np.clip(np.floor(np.round(v, 6) + 0.5), 0, 255)
    pre = r.astype(float)
    pre[..., :3] = np.floor(pre[..., :3] * pre[..., 3:] / 255 + 0.5)
    pre = level(np.einsum("ow,hwc->hoc", weights(r.shape[1], width, method), pre, optimize=True))
    pre = level(np.einsum("oh,hwc->owc", weights(r.shape[0], height, method), pre, optimize=True))
    a = pre[..., 3:]
    pre[..., :3] = np.where(a == 0, 0, np.minimum(255, np.floor(pre[..., :3] * 255 / np.maximum(a, 1))))
    return pre.astype(np.uint8)


def cap_size(r: np.ndarray, max_edge: int) -> np.ndarray:
    h, w = r.shape[:2]
    if not max_edge or max(h, w) <= max_edge:
        return r
    side = lambda n: max(1, round(n * (max_edge / max(h, w))))
    return resize(r, side(w), side(h))


def _block(v: np.ndarray) -> np.ndarray:
    """The nine values around each place, the edge again beyond the border."""
    h, w = v.shape
    p = np.pad(v, 1, mode="edge")
    return np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def denoise(r: np.ndarray) -> np.ndarray:
    """The 3 x 3 median of each colour channel; alpha stays."""
    return np.stack([*(np.median(_block(r[..., c]), axis=0).astype(r.dtype) for c in range(3)), r[..., 3]], -1)


def analyze(r: np.ndarray, edge: int = 256) -> dict:
    """Figures and class of a raster, from every so many rows and columns."""
    step = max(1, max(r.shape[:2]) // edge)
    s = r[::step, ::step]
    luma = s[..., 0] * 0.299 + s[..., 1] * 0.587 + s[..., 2] * 0.114
    opaque = s[..., 3] > 127.5
    n = int(opaque.sum())
    out = {"samples": n, "transparency": float((s[..., 3] < 0.99 * 255).mean()), "carrying": carrying_colors(s[..., :3][opaque])}
    if n < LEAST_SAMPLES:
        return out | {"texture": 0.0, "spread": 0.0, "flatness": 1.0, "kind": "illustration", "confidence": 0.0}
    around = _block(luma)
    span = (around.max(0) - around.min(0))[opaque]
    t, spread, flat = float(np.abs(luma - np.median(around, axis=0))[opaque].mean()), float((span > STEP).mean()), float((span < STEP).mean())
    q = s[..., :3][opaque].astype(int) >> 3
    unique = len(np.unique(q[:, 0] << 10 | q[:, 1] << 5 | q[:, 2]))
    if t >= TEXTURE and spread >= SPREAD:
        kind, sure = "photo", min(1.0, t / 3.2)
    elif flat > FLATNESS and unique < COLOURS:
        kind, sure = "icon", min(1.0, flat)
    else:
        kind, sure = "illustration", 0.5 + min(0.45, abs(t - TEXTURE) / 3.2)
    return out | {"texture": t, "spread": spread, "flatness": flat, "kind": kind, "confidence": sure, "unique_colors": unique}


def drop_backdrop(r: np.ndarray, tolerance: float = 12.0) -> tuple[np.ndarray, bool]:
    """r with alpha 0 where a uniform border's colour reaches in from the edge, and whether that was done: not where the border is uneven,
    where next to nothing or nearly all would go, or where many separate pieces would be left, as of a starry sky."""
    border = np.concatenate([r[0], r[-1], r[:, 0], r[:, -1]])[:, :3].astype(float)
    middle = np.median(border, axis=0)
    if np.abs(border - middle).mean() > UNIFORM:
        return r, False
    near = (np.abs(r[..., :3] - middle).max(-1) <= tolerance) & (r[..., 3] > 0)
    parts = label4(near.astype(np.int64))
    edge = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    gone = np.isin(parts, edge[edge > 0])
    if not LEAST_SHARE <= gone.mean() <= MOST_SHARE:
        return r, False
    rest = label4((~gone).astype(np.int64))
    outer = np.unique(np.concatenate([rest[0], rest[-1], rest[:, 0], rest[:, -1]]))
    if len(np.setdiff1d(np.unique(rest), np.append(outer, 0))) > MOST_ISLANDS:
        return r, False
    out = r.copy()
    out[gone, 3] = 0
    return out, True


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of sRGB levels for the D65 white and the two-degree observer."""
    level = np.arange(256) / 255.0
    v = np.where(level > 0.04045, ((level + 0.055) / 1.055) ** 2.4, level / 12.92)[rgb.astype(np.uint8)]
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    t = v @ m.T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def supersample_cap(width: int, height: int) -> int:
    longest = max(width, height)
    return 1 if longest > 1400 else 2 if longest > 700 else 3 if longest > 360 else 4


def adapted_clusters(flatness: float, carrying: int, clusters: int, min_clusters: int = 10) -> int:
    """Clusters for a raster's content: fewer the flatter it is, and no more than the colours that carry it."""
    fewer = max(min_clusters, round(clusters * (1 - 0.62 * flatness)))
    if carrying > 0 and flatness >= 0.35:
        fewer = min(fewer, max(4, carrying))
    return max(2, fewer)


def summary(found: dict) -> str:
    return f"{found['kind']} ({math.floor(100 * found['confidence'] + 0.5)} % sure): texture {found['texture']:.2f}, {100 * found['flatness']:.0f} % flat, carried by {found['carrying']} colours"
