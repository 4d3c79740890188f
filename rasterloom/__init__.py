"""Raster analytics on Spark: images as relations of pixels, regions, edges, contours and paints."""

__version__ = "0.1.0"
