"""The queries of this package and their SQL."""

from __future__ import annotations

from . import cooccurrence, packing, quantiles, tokens, toxicity

_MODULES = [cooccurrence, quantiles, tokens, packing, toxicity]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
