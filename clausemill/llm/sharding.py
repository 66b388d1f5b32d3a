"""Sharding: a Feistel permutation with cycle walking over global row numbers.

The permutation is a pure function of the row number, the row count and a seed: shard and slot of any
row are computable without the data, and its inverse is the same rounds run backwards. A row number is
the rank by doc_id, text checksum and size, so a rerun over the same rows gives the same layout.

Defined cases: a null text has size 1 and checksum 0; a null doc_id sorts first; repeated rows are rows
of their own; an empty table gives an empty result; other input columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stage, table

ROUNDS = 6
SEED = 20240607


def permuted(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of row number `x` in a permutation of 0 .. n - 1.

    The rounds act on a grid of a x b >= n cells, less than one row of cells larger than n; a place
    outside is permuted again until it is inside. A walk is no longer than the cells outside plus one;
    beyond 64 steps (a chance under n^-32) the query fails rather than give a wrong place.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    steps = min(a * b - n + 1, 64)

    def once(v: Column) -> Column:
        def mix(half: Column, k: Column, size: int) -> Column:
            return F.pmod(F.xxhash64(half, k, F.lit(seed)), F.lit(size).cast("long"))

        def one_round(s: Column, k: Column) -> Column:
            left, right = s["l"], s["r"]
            new_left = F.when(k % 2 == 0, (left + mix(right, k, a)) % a).otherwise(left)
            new_right = F.when(k % 2 == 1, (right + mix(left, k, b)) % b).otherwise(right)
            return F.struct(new_left.alias("l"), new_right.alias("r"))

        start = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b).cast("long")).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(rounds - 1)), start, one_round, lambda s: s["l"] * b + s["r"]
        )

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), once(x), lambda v, _: F.when(v >= n, once(v)).otherwise(v)
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard(rows: DataFrame, order: list[str], n_shards: int, seed: int = SEED) -> DataFrame:
    """`rows` (narrow) with `row_no`, `position`, `shard` and `slot`; shard sizes differ by one at most."""
    placed = numbered(stage(rows, "shard-sizes"), order, "shard-rows")  # staged: a range shuffle reads its input twice
    n = placed.count()
    out = placed.withColumn("position", permuted(F.col("row_no"), n, seed))
    return out.withColumn("shard", F.pmod("position", F.lit(n_shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / n_shards).cast("long")
    )


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(rows, ["doc_id", "text_crc32", "size"], 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_feistel_sharding": op7_feistel_sharding}
ORACLE_SQL: dict[str, str] = {}  # crc32 is no DuckDB function; tests hold it against brute force
