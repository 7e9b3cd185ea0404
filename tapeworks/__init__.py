"""Finite-state text analytics and training-data operators on Spark DataFrames."""
