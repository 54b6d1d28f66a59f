"""Document, graph, rule and time-series analytics on Spark DataFrames."""
