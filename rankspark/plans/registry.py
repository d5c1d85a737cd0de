"""Registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from . import construction, formulas, lexical, ranking, replay, reports, runs, statistics, storage  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
