"""Order-book and tick analytics on Spark DataFrames."""
