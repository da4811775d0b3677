"""The queries that the driver runs, with the SQL that gives the same rows."""

from __future__ import annotations

from factlog.plans import graph_queries, log_queries, process_queries

QUERIES: dict = {**log_queries.Q, **graph_queries.Q, **process_queries.Q}
ORACLE_SQL: dict = {**log_queries.SQL, **graph_queries.SQL, **process_queries.SQL}
FLAGSHIP = "r13_recall"
