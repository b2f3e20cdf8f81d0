"""All queries of the engine by name, and their SQL twins."""

from __future__ import annotations

from . import graphs, mapping, quality, understanding

_ALL = (understanding, graphs, quality, mapping)
QUERIES: dict = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _ALL for k, s in m.SQL.items()}
