"""Satellite-scene analytics on Spark: scenes, pixels, angles and time series as DataFrames."""
