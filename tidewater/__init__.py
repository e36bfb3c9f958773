"""Tidewater: market time-series analytics and corpus preparation on Spark DataFrames."""
