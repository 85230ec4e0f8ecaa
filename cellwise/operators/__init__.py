"""Transformations of long ensemble tables: DataFrames in, DataFrames out, keyed by cell."""
