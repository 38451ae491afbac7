"""Tidemark: multi-version key-value change logs as DataFrames."""
