"""All queries of the library and their SQL twins."""

from __future__ import annotations

from .queries import analytics, features, indicators, trading

QUERIES, SQL = {}, {}
for part in (indicators, analytics, features, trading):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
