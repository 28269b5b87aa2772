"""All queries over the driver's tables by name, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from shiftscope.plans import evaluation_queries, file_queries, model_queries, table_queries

QUERIES: dict[str, Callable] = table_queries.QUERIES | evaluation_queries.QUERIES | model_queries.QUERIES | file_queries.QUERIES
ORACLE_SQL: dict[str, str] = table_queries.ORACLE_SQL | evaluation_queries.ORACLE_SQL | model_queries.ORACLE_SQL | file_queries.ORACLE_SQL
