"""Strings of vector documents and reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import d


def path_number(value: Column, precision: int = 1) -> Column:
    """Shortest text of a coordinate: no trailing zeros, no zero before the point, no minus zero."""
    fixed = F.format_string(f"%.{precision}f", F.bround(value, precision))
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    bare = F.regexp_replace(short, r"^(-?)0\.", "$1.")
    return F.when(bare.isin("-0", "", "-"), "0").otherwise(bare)


def attribute_number(value: Column, precision: int = 2) -> Column:
    fixed = F.format_string(f"%.{precision}f", F.bround(value, precision))
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def join_numbers(tokens: Column) -> Column:
    """Tokens with a space only where their beginnings would not tell them apart."""
    glue = lambda so_far, t: F.when((so_far == "") | t.startswith("-"), F.concat(so_far, t)).when(t.startswith(".") & F.regexp_like(so_far, F.lit(r"\.[0-9]*$")), F.concat(so_far, t)).otherwise(F.concat(so_far, F.lit(" "), t))
    return F.aggregate(tokens, F.lit(""), glue)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.bround(c).cast("int")))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def human_bytes(n: Column) -> Column:
    kb = n / d(1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(kb < d(1024), F.concat(F.format_string("%.1f", F.bround(kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(kb / d(1024), 1)), F.lit(" MB")))


def human(n: int) -> str:
    """human_bytes of one number."""
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def count_nodes(document: Column) -> Column:
    """Path commands inside the d attributes of a document."""
    paths = F.array_join(F.regexp_extract_all(document, F.lit(r'\sd="([^"]*)"'), F.lit(1)), " ")
    return F.regexp_count(paths, F.lit("[MmLlHhVvCcSsQqTtAaZz]"))


def destination(path: Column, folder: str | None = None) -> Column:
    """The name of an image's vector file: beside it, or in folder."""
    svg = F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".svg"))
    return svg if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(svg, r"([^/]+)$", 1))
