"""Market-data pipelines and point-in-time analytics on Spark DataFrames."""
