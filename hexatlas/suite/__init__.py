"""Registered queries: one per operator, each with the SQL that must give the same rows."""

from hexatlas.suite.base import ORACLES, QUERIES
from hexatlas.suite import (  # noqa: F401
    beats, comparisons, diversity, layers, models, rasters, stores, tiles)

__all__ = ["QUERIES", "ORACLES"]
