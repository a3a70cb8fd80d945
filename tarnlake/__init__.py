"""Snapshot-based lakehouse tables with incremental views, on plain Spark DataFrames."""
