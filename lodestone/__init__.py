"""Lodestone: search-index analytics and training-data preparation on Spark DataFrames."""
