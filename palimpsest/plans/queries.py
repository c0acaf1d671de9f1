"""The registry of the wiki queries and their SQL."""

from __future__ import annotations

from palimpsest.plans import graphs, roundtrips, sets, stats, texts

_MODULES = (stats, texts, sets, graphs, roundtrips)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in _MODULES for k, sql in m.ORACLE_SQL.items()}
