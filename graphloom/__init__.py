"""Graph representation learning and graph analytics on Spark DataFrames."""
