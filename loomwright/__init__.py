"""Declarative data preparation and column catalog on Spark DataFrames."""
