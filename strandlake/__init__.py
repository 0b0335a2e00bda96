"""Sequence-read analytics on Spark DataFrames."""
