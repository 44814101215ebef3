"""Operators over batches: DataFrames in, DataFrames out."""
