"""Images to vector documents. An image is one group; failures are rows that name the stage.

Load (size cap, backdrop, content class, settings), palette, areas at super-sampled size, soft edges given back, small areas absorbed, alike ones merged
under one paint, curves, document. What is sequential within one image is NumPy in functions; between images there is nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content, curves, kernels, paints, segments
from ..operators.batch import PRESETS, settings
from ..operators.text import human

RESULT = (
    "image_id long, ok boolean, error string, width int, height int, regions int, segments int, svg string, "
    "stage string, preset string, kind string, threshold double, gradients int, nodes int, summary string, warnings array<string>"
)
NAMES = [part.split()[0] for part in RESULT.split(", ")]
#: The stages in order, colours of the training sample, and the share of see-through pixels from which alpha is drawn.
STAGES = ("load", "palette", "regions", "merge", "document")
SAMPLE, SEEN_THROUGH = 20_000, 0.06


def segment(r: np.ndarray, options: dict, step: Callable[[str], None] = lambda name: None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Parts, colours and alpha of a straight-alpha raster at scale times its size, and that scale. A raster without ink has no parts."""
    h, w = r.shape[:2]
    scale = max(1, min(options["supersample"], content.supersample_cap(w, h)))
    step("palette")
    ink = r[..., 3] >= 128
    if not ink.any():
        ink = r[..., 3] > 0
    if not ink.any():
        return np.zeros((h, w), np.int64), r[..., :3], r[..., 3] / 255.0, 1
    points = content.lab(r[..., :3][ink])
    rng = np.random.default_rng(12345)
    sample = points[rng.choice(len(points), min(len(points), SAMPLE), replace=False)]
    clusters = min(options["init_clusters"], max(2, kernels.carrying_colors(r[..., :3][ink].astype(float)) * 4))
    centres = np.unique(np.round(kernels.kmeans(sample, clusters), 9), axis=0)
    step("regions")
    big = content.resize(r, w * scale, h * scale, options["resample"]) if scale > 1 else r
    soft = (r[..., 3][ink] < 230).mean() > SEEN_THROUGH
    inside = big[..., 3] >= 128
    if not inside.any():
        inside = big[..., 3] > 0
    features = content.lab(big[..., :3])
    labels = np.zeros(inside.shape, np.int64)
    labels[inside] = kernels.nearest(features[inside], centres) + 1
    parts = kernels.label4(labels).astype(np.int64)
    parts = kernels.label4(segments.reassign_blends(parts, features, scale)).astype(np.int64)
    parts = segments.within_budget(parts, features, options["min_region_px"] * scale * scale, options["max_initial_regions"])
    plain = content.resize(r, w * scale, h * scale, "bilinear") if scale > 1 else r  # paints are fitted to colours between those of the source, never beyond
    return parts, plain[..., :3], plain[..., 3] / 255.0 if soft else np.ones(inside.shape), scale


def _paths(mask: np.ndarray, scale: int, options: dict) -> tuple[str, int]:
    """Path data of a mask, and how many cubics it has."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return "", 0
    corner = np.array([columns[0], rows[0]])
    data, count = "", 0
    for ring in kernels.contours(mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]):
        ring = (ring + corner) / scale
        x, y = ring.T
        if abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2 < options["min_path_area"]:
            continue
        fitted = curves.fit_closed(ring, options["curve_tolerance"], max(2, scale) if scale > 1 else 3, options["corner_angle"], options["smooth_passes"])
        count += len(fitted)
        data += curves.path_data(fitted, options["precision"])
    return data, count


def _coalesced(body: list[tuple[str, str, tuple[float, ...], bool]]) -> list[tuple[str, str]]:
    """Paths of one flat fill as one element, where nothing painted between them overlaps: (attributes, data, box, flat) in paint order."""
    out: list[list] = []
    overlap = lambda a, b: a[0] < b[2] + 0.5 and b[0] < a[2] + 0.5 and a[1] < b[3] + 0.5 and b[1] < a[3] + 0.5
    for how, data, box, flat in body:
        for group in reversed(out) if flat else ():
            met = any(overlap(box, one) for one in group[2])
            if group[0] == how and not met:
                group[1] += data
                group[2].append(box)
                break
            if met:
                out.append([how, data, [box]])
                break
        else:
            out.append([how, data, [box]])
    return [(how, data) for how, data, _ in out]


def assemble(parts: np.ndarray, regions: Sequence[segments.Region], scale: int, options: dict, width: int, height: int, opaque: bool) -> tuple[str, int, int]:
    """The document of painted regions, its curve segments and its ramps: the largest first, each grown under what is painted over it."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}">'
    inside = parts > 0
    ordered = sorted(regions, key=lambda r: (-len(r.pixels), r.number))
    body, defs, count = [], [], 0
    for z, region in enumerate(ordered):
        if z == 0 and opaque and options["base_layer"]:
            mask = inside  # the base: the whole drawing under the largest region's paint
        else:
            mask = np.zeros(parts.shape, bool)
            mask.flat[region.pixels] = True
            mask = segments.dilate(mask, options["seam_overlap"]) & inside if opaque and z else mask
        data, n = _paths(mask, scale, options)
        if not data:
            continue
        count += n
        name = f"g{len(defs) + 1}"
        if element := paints.definition(region.paint, name):
            defs.append(element)
        y, x = np.unravel_index(region.pixels, parts.shape)
        body.append((paints.attributes(region.paint, name), data, (x.min() / scale, y.min() / scale, (x.max() + 1) / scale, (y.max() + 1) / scale), element is None and z > 0))
    drawn = "".join(f'<path {how} fill-rule="evenodd" d="{data}"/>' for how, data in _coalesced(body))
    return head + (f"<defs>{''.join(defs)}</defs>" if defs else "") + drawn + "</svg>", count, len(defs)


def documents(r: np.ndarray, options: dict, thresholds: Sequence[float], step: Callable[[str], None] = lambda name: None) -> Iterator[tuple[float, str, int, int, int]]:
    """For each merge threshold the document, its regions, curve segments and ramps; the areas are found once."""
    parts, rgb, alpha, scale = segment(r, options, step)
    step("merge")
    h, w = r.shape[:2]
    opaque = bool((alpha >= 1).all())
    for threshold, regions in segments.merge(parts, rgb, alpha, scale, options, sorted(thresholds)):
        step("document")
        svg, count, ramps = assemble(parts, regions, scale, options, w, h, opaque)
        yield threshold, svg, len(regions), count, ramps
        step("merge")


def trace_image(r: np.ndarray, options: dict) -> tuple[str, int, int]:
    """The document of one straight-alpha raster (rows, columns, 4), its areas and its curve segments."""
    _, svg, regions, count, _ = next(documents(r, options, [options["merge_tolerance"]]))
    return svg, regions, count


def prepared(r: np.ndarray, preset: str, quality: str, overrides: dict | None, max_edge: int, background: str) -> tuple[np.ndarray, str, dict, dict, list[str]]:
    """The raster to trace, the preset and settings for its content, what was found, and warnings."""
    small = content.cap_size(r, max_edge)
    if background == "remove" or background == "auto" and (r[..., 3] == 255).all():
        small, _ = content.drop_backdrop(small)
    found = content.analyze(small)
    chosen = found["kind"] if preset == "auto" else preset
    options = settings(chosen, quality, overrides)
    options["init_clusters"] = content.adapted_clusters(found["flatness"], found["carrying"], options["init_clusters"], options["min_clusters"])
    options |= {k: v for k, v in (overrides or {}).items() if v is not None}
    if options["denoise"] >= 2:
        small = content.denoise(small)
    notes = ["photographic content under a drawing preset"] if found["kind"] == "photo" and chosen not in ("photo", "poster") else []
    notes += ["the image was reduced"] if small.shape != r.shape else []
    return small, chosen, options, found, notes


def trace(
    pixels: DataFrame, preset: str = "icon", quality: str = "balanced", overrides: dict | None = None, max_edge: int = 1024, background: str = "keep", thresholds: Sequence[float] | None = None
) -> DataFrame:
    """RESULT for every image of pixels, and for every threshold if some are given. Preset (or auto), quality and overrides are checked before anything runs.

    background: keep; remove, where the guards allow it; auto, which removes it from opaque images.
    """
    if preset != "auto":
        settings(preset, quality, overrides)
    elif quality:
        settings(next(iter(PRESETS)), quality, overrides)
    if background not in ("keep", "remove", "auto"):
        raise ValueError("background must be one of auto, keep, remove")

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = ["load"]
        base = dict.fromkeys(NAMES) | {"image_id": int(key[0])}
        rows = []
        try:
            y, x = frame["y"].to_numpy(), frame["x"].to_numpy()
            if frame.isna().any().any():
                raise ValueError("a place or level is null")
            raster = np.zeros((y.max() + 1, x.max() + 1, 4), np.uint8)
            raster[y, x] = frame[["r", "g", "b", "a"]].to_numpy()
            small, chosen, options, found, notes = prepared(raster, preset, quality, overrides, max_edge, background)
            base |= {"preset": chosen, "kind": found["kind"], "summary": content.summary(found), "warnings": notes}
            for threshold, svg, regions, count, ramps in documents(small, options, thresholds or [options["merge_tolerance"]], lambda name: at.__setitem__(0, name)):
                nodes = sum(c.isalpha() for data in svg.split(' d="')[1:] for c in data.split('"', 1)[0])
                figures = {"width": small.shape[1], "height": small.shape[0], "regions": regions, "segments": count, "gradients": ramps, "nodes": nodes}
                rows.append(base | figures | {"ok": True, "svg": svg, "threshold": threshold})
        except Exception as e:  # one bad image is a row, not the end of the batch
            rows.append(base | {"ok": False, "error": f"{type(e).__name__}: {e}", "stage": at[0]})
        return pd.DataFrame(rows, columns=NAMES)

    return pixels.select("image_id", "y", "x", "r", "g", "b", "a").groupBy(F.col("image_id").cast("long").alias("image_id")).applyInPandas(one, RESULT)


def single_report(row) -> list[tuple[str, str]]:
    """Labelled lines about one RESULT row."""
    if not row["ok"]:
        return [("failed", f"{row['error']} ({row['stage']})")]
    lines = [("content", row["summary"]), ("preset", row["preset"]), ("size", f"{row['width']} x {row['height']}"), ("regions", f"{row['regions']}, {row['gradients']} ramps")]
    return [*lines, ("nodes", str(row["nodes"])), ("document", human(len(row["svg"].encode()))), *(("note", w) for w in row["warnings"])]


def batch_table(results: DataFrame) -> DataFrame:
    """One line for each image: content, regions, nodes, bytes, and what failed."""
    size = F.octet_length("svg")
    return results.select("image_id", "kind", "regions", "nodes", size.alias("svg_bytes"), "ok", F.when(~F.col("ok"), F.concat_ws(": ", "stage", "error")).alias("failure")).orderBy("image_id")


def exit_status(results: DataFrame) -> int:
    """2 without any image, 1 if one failed, else 0."""
    n, failed = results.agg(F.count("*"), F.count_if(~F.col("ok"))).first()
    return 2 if not n else 1 if failed else 0
