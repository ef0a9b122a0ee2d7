"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tidemill.functions import converters, fuzzy, text
from tidemill.operators import advice, checks, checksums, discovery, docstore, graph, hierarchy, keys, masking, projection, scans, splits, summaries, textindex, verify
from tidemill.plans import migration
from tidemill.plans.declare import Query
from tidemill.sources import connections, ledger, sinks, sqlite
from tidemill.streaming import changes, incremental

FLAGSHIP = "project_document_orders"
MODULES = (scans, keys, converters, text, fuzzy, textindex, summaries, splits, masking, checks, docstore, verify, checksums, discovery, hierarchy, graph, projection, advice, connections, sinks, ledger, sqlite, incremental, changes, migration)

QUERIES: dict[str, Query] = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.QUERIES.sql.items()}
