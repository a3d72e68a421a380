"""Price-series analytics and synthesis on Spark DataFrames."""

__version__ = "0.1.0"
