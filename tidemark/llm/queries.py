"""Imports the modules that register queries."""

from . import (  # noqa: F401
    binary, counting, embeddings, exact, language, minhash, packing, phrases, quality, resampling, suffix, toxicity, transducer,
)
from .registry import ORACLES, QUERIES  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
