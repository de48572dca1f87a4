"""All queries of the reference's operators over the tables of a directory, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitik.plans import build_queries, corpus_queries, engine_queries, lexicon_queries, update_queries

_MODULES = (corpus_queries, lexicon_queries, update_queries, engine_queries, build_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
