"""Content-risk analytics on Spark DataFrames."""
