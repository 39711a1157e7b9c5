"""Commerce analytics on Spark DataFrames: sources, operators and analytic plans."""
