"""spanloom: corpus analytics on Spark DataFrames."""
