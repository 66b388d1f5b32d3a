"""A training corpus from raw documents: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` applies them to the documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm.common import shared_dir, table
from clausemill.llm.decontamination import stage_decontamination
from clausemill.llm.packing import stage_packing
from clausemill.llm.pii import stage_pii
from clausemill.llm.quality_classifier import stage_quality
from clausemill.llm.simhash import stage_near_dedup

STAGES = [
    ("quality classifier", stage_quality),
    ("near-dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("personal data", stage_pii),
    ("packing", stage_packing),
]

#: Fitted models, XXH64 and a tokenizer: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
