"""Spark-native operators for electricity-grid time series.

Every operator takes DataFrames and returns DataFrames. The data model is a
wide table with one row per (series, hour); ``keys=[...]`` names the series
columns and may be empty for a single series.
"""
