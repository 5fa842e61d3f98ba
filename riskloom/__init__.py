"""Entity-scoped risk narratives from large collections of short posts, on Spark DataFrames."""
