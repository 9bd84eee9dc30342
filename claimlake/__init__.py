"""Claim checking and claim correction data on Spark DataFrames."""
