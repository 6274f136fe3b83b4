"""Text-corpus and embedding analytics on Spark DataFrames."""
