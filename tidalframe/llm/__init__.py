"""Operators of a large-scale training-data pipeline; nothing else in the package imports this folder."""
