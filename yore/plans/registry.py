"""Queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from yore.plans import aggregation, deeper, fold, leaves, more, relations, scalars, stored, times
from yore.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregation", "deeper", "fold", "leaves", "more", "relations", "scalars", "stored", "times"]
