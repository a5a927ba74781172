"""Spark-native analytics for market-style time series.

Everything is a function from DataFrames (or Columns) to DataFrames (or
Columns); a missing value stays missing unless a docstring says otherwise.
"""
