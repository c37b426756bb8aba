"""Catalogue analytics on Spark: every operator takes DataFrames and column names and returns a DataFrame."""
