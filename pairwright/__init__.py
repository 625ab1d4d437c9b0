"""pairwright: weighted-graph matching and analytics on Spark DataFrames."""
