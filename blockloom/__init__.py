"""Markdown block-identity analytics on Spark DataFrames."""
