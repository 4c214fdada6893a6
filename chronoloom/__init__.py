"""Temporal entity resolution and data mastering on Spark DataFrames."""
