"""Linkweave: record linkage and link data processing on Spark DataFrames."""
