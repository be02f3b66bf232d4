"""Space-time matching, aggregation, event timing and skill scoring on Spark DataFrames."""

__version__ = "0.1.0"
