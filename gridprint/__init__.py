"""Interpretable text retrieval and analytics on PySpark DataFrames."""
