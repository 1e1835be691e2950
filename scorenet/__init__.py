"""scorenet: scored-network analytics on Spark DataFrames."""
