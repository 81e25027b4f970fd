"""Lookalike-domain and training-corpus analytics on Spark DataFrames."""
