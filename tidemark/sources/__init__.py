"""Scans, upserts and sinks over Parquet tables."""
