"""Knowledge-graph analytics on Spark DataFrames."""
