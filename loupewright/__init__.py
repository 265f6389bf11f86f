"""Factory-operations analytics on Spark: every query is a function from DataFrames to a DataFrame."""
