"""Point-in-time analytics expressed with Spark DataFrames."""

__version__ = "0.1.0"
