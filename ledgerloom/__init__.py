"""Fact, relation and retrieval jobs on Spark DataFrames."""
