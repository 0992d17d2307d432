"""Commerce analytics on Spark: operators, sources, functions, plans and streaming as DataFrame code."""
