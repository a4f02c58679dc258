"""Corpus preparation, inverted-index search and evaluation on Spark DataFrames."""
