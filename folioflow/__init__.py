"""Document-corpus analytics as Spark DataFrames."""
