"""textmill: text-corpus and evaluation analytics on Spark DataFrames."""
