"""Analytics for conversational event streams, written for Spark DataFrames."""
