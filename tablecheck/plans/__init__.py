"""Registered queries over the test tables (one module per area)."""

from . import actions, delegated, grading, runs, streams, texts, warehouse  # noqa: F401
from .registry import ORACLES, QUERIES, TABLES  # noqa: F401
