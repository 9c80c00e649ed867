"""Operators on panels: DataFrames in, DataFrames or columns out, nothing collected."""
