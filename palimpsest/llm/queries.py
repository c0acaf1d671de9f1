"""The registry of the training-data operators: opN_<name> queries and their SQL."""

from __future__ import annotations

from palimpsest.llm import chat, decontaminate, jaccard, langid, licenses, packing, quality, secrets, substrings, urls

_MODULES = (chat, decontaminate, jaccard, langid, licenses, packing, quality, secrets, substrings, urls)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in _MODULES for k, sql in m.ORACLE_SQL.items()}
