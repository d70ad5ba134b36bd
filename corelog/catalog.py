"""All queries over the library's own operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from corelog.queries import aggregates, conformal, folds, geo, grids, inference, joins, profiles, relational, sampling, scans, texts  # noqa: F401
from corelog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
