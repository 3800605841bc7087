"""Hourly network-activity analytics on Spark: DataFrames in, DataFrames out."""
