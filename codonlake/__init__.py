"""Genome feature analytics on Spark DataFrames."""
