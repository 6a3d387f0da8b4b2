"""Every query of the engine itself, with its SQL for a second engine."""

from __future__ import annotations

from millrace.plans import division, documents, events, graphs, project

_PARTS = (documents, graphs, events, division, project)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
