"""All registered queries of the library, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, judges, lanes, relational, retrieval, steps, verbs

MODULES = (retrieval, documents, relational, lanes, verbs, steps, judges)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk_clauses(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
