"""Content-addressed review analytics on Spark DataFrames."""
