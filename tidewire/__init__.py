"""Traffic analytics on Spark DataFrames."""
