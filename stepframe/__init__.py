"""stepframe: step-style data programs on Spark DataFrames."""

__version__ = "0.1.0"
