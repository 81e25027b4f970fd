"""All registered queries."""

from __future__ import annotations

from decoyscope.plans import dashboards, history, matching, pages, scoring, streams, urls  # noqa: F401  they register
from decoyscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
