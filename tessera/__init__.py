"""Curation, scoring and evaluation analytics over Spark DataFrames."""
