"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from sievelake.plans import catalogue, entities, landings, queues, readings, reports, runs, scoring, texts, writes  # noqa: F401
from sievelake.plans.base import ORACLE, QUERIES

FLAGSHIP = "latest_run_health"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
