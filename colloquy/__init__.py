"""Dialog analytics on Spark: sources, column functions, operators, plans and streaming jobs."""
