"""Time-aligned text and evidence analytics on Spark DataFrames."""
