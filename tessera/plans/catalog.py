"""Named queries over the driver's tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

from . import cohort, evaluation, matrices, runs, scans, selection, text  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
