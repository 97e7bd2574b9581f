"""Lectern: documentation retrieval on Spark DataFrames."""
