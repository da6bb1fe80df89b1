"""Relational operators of incremental ingestion: DataFrames in, DataFrames out."""
