"""All queries of this subpackage by name, with SQL where it can say them on whole tables."""

from __future__ import annotations

from lodestrata.llm import queries_mixes, queries_pairs, queries_text, queries_tokens

_MODULES = [queries_mixes, queries_pairs, queries_text, queries_tokens]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
