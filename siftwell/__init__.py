"""Staged code and text search analytics on Spark DataFrames."""
