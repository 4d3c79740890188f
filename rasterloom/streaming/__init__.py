"""Incremental image ingestion."""
