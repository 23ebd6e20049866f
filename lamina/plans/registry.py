"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lamina.plans import evaluation, runs, training  # noqa: F401  they add their queries
from lamina.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "pairwise_accuracy_tol"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
