"""Image analytics on Spark DataFrames."""
