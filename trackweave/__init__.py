"""Spot and track analytics on Spark DataFrames."""
