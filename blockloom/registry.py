"""All queries of the catalog operators, with their SQL twins."""

from __future__ import annotations

from blockloom.plans import catalog, intervals, journals, keyed, references, rules, sets, streams, versions, views

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (catalog, keyed, references, intervals, journals, sets, streams, versions, views, rules):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
