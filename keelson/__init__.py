"""Typed record tables and their queries on Spark DataFrames."""

__version__ = "0.1.0"
