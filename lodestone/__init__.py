"""Lodestone: document retrieval and analytics on Spark DataFrames."""
