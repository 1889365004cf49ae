"""The registered queries of the masking library and their DuckDB oracles."""

from __future__ import annotations

from maskframe.jobs import kinds, masking, network, payloads

_ALL = {**masking.QUERIES, **network.QUERIES, **payloads.QUERIES, **kinds.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
