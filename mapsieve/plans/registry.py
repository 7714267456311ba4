"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from mapsieve.plans import queries_classify, queries_flows, queries_more, queries_page, queries_search, queries_spatial, queries_tables

_PARTS = (queries_classify, queries_page, queries_search, queries_spatial, queries_tables, queries_more, queries_flows)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
