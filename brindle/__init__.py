"""Analytics and data processing on Spark DataFrames."""
