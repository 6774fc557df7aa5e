"""Social-post and network analytics on Spark DataFrames."""
