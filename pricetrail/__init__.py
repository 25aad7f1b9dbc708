"""Versioned retail price catalogs on Spark DataFrames."""
