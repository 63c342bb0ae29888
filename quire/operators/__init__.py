"""Operators on the tables of documents: DataFrames in, DataFrames out, nothing computed on the way."""
