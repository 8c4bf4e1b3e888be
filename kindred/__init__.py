"""Near-duplicate, ranking and forensics analytics on Spark DataFrames."""
