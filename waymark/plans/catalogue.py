"""All queries of the trajectory engine by name, with their SQL twins."""

from __future__ import annotations

from waymark.plans import motion, relational, spatial, stores, tokens  # noqa: F401
from waymark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
