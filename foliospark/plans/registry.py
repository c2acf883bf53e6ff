"""All queries of the library and the SQL that each is compared with."""

from __future__ import annotations

from . import addresses, aggregates, files, imports, incremental, labels, leases, parties, places, relational, scalars, selections, texts

FLAGSHIP = "j04_a10_point_in_time_owners"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (scalars, imports, labels, addresses, files, selections, texts, parties, places, leases, relational, aggregates, incremental):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
