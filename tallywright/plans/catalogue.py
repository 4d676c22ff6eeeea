"""Registry of the engine's queries and of the SQL each is checked against."""

from __future__ import annotations

from . import admission, catalogued, compiled, detection, findings, governed, intake, metrics, ordered, runs, streams

MODULES = (governed, metrics, detection, findings, intake, admission, ordered, streams, runs, catalogued, compiled)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
