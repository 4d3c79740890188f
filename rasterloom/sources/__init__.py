"""Readers and writers of rasters and reports."""
