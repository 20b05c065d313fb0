"""Operators on DataFrames: intervals, MinHash, statistics, mixtures."""
