"""The queries of the subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, licenses, packing, pii, quality_classifier, quality_rules, sharding, simhash, token_store

MODULES = (quality_rules, decontamination, quality_classifier, packing, licenses, chat_format, sharding, simhash, token_store, pii)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
