"""Queries of the analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewise.plans import audits, copy_sim, kernel_queries, rank_queries, relational, reports, scoring, sources_queries, spec_queries, trading, wallet_score_queries
from tapewise.plans.dialect import duck, spark

_TEXTS = {**relational.SQL, **scoring.SQL, **audits.SQL}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{k: spark(relational.SPARK.get(k, v)) for k, v in _TEXTS.items()}, **kernel_queries.QUERIES, **trading.QUERIES, **copy_sim.QUERIES, **sources_queries.QUERIES, **rank_queries.QUERIES, **reports.QUERIES, **spec_queries.QUERIES, **wallet_score_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**{k: duck(v) for k, v in _TEXTS.items()}, **kernel_queries.ORACLE_SQL, **trading.ORACLE_SQL, **reports.ORACLE_SQL, **sources_queries.ORACLE_SQL, **spec_queries.ORACLE_SQL, **wallet_score_queries.ORACLE_SQL}
