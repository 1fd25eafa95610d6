"""Road-safety analytics on Spark DataFrames."""
