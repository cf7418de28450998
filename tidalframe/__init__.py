"""Ordered-series analytics and training-data operators on PySpark."""
