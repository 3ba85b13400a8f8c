"""Geodetic station time series on Spark DataFrames."""
