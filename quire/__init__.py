"""Quire: document analytics on Spark DataFrames."""
