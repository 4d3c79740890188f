"""Relational raster operators."""
