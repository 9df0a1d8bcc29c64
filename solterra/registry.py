"""Registered queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from .plans import exposure, files, geo, graph, light, mobility, reports, rows, solver

_PLANS = [mobility, light, graph, exposure, rows, geo, reports, files, solver]
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
FLAGSHIP = "agg_irbm_day"
