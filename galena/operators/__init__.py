"""Relational operators over column names: DataFrames in, DataFrames out, no clock and no collect."""
