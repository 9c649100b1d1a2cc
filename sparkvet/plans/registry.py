"""All queries over the driver's tables and their DuckDB equivalents, by name."""

from __future__ import annotations

from sparkvet.plans import driver_queries, packages, rule_queries

QUERIES = driver_queries.QUERIES | rule_queries.QUERIES | packages.QUERIES
ORACLES = driver_queries.ORACLES | rule_queries.ORACLES
