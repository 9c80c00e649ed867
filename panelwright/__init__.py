"""Panel and point-in-time analytics on Spark DataFrames."""
