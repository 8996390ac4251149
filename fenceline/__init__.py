"""Analytics over lease-based job coordination, expressed as Spark DataFrames."""

__version__ = "0.1.0"
