"""Relational operators of record linkage, each a function from DataFrames to a DataFrame."""
