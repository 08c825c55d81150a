"""Operators over graphs: DataFrames in, DataFrames out."""
