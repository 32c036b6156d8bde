"""Spark-native HTML analytics: parse page columns into node tables and query them as DataFrames."""

__version__ = "0.1.0"
