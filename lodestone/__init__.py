"""Lodestone: faceted catalogue search and search analytics on Spark DataFrames."""
