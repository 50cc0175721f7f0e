"""Text, token-sequence and tree analytics on Spark DataFrames."""
