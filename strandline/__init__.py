"""Subspace and outlier analytics on Spark DataFrames."""
