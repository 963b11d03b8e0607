"""Operators of a training-data pipeline, each with its registered query."""

from hexatlas.llm.base import ORACLES, QUERIES
from hexatlas.llm import decontamination, licenses, merkle, mixing, pitman_yor, quality, simhash, spelling, substrings, toxicity, vantage, warc, whitening  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
