"""All queries of the library's own operators."""

from . import cleaning, evaluation, features, files, labelling, learning, lookups, monitoring, regimes, reviews, scans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
