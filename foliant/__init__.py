"""foliant: hybrid retrieval, corpus construction and corpus quality on Spark DataFrames."""
