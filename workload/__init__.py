"""Registered queries: each operator on the test tables, next to the SQL it must agree with."""

from . import q_bars, q_book, q_exogenous, q_flow, q_labels, q_models, q_scalars, q_sources, q_streaming  # noqa: F401
from .registry import QUERIES, bound, oracles

__all__ = ["QUERIES", "bound", "oracles"]
