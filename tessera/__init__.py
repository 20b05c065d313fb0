"""Interval, similarity and mixture analytics on Spark DataFrames."""
