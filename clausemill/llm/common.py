"""What the operators share: tables, global numbering, components; staging in the shared folder is the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, stage

__all__ = ["WORD", "components", "let", "numbered", "shared_dir", "stage", "table"]

#: A word, as every contract of this subpackage has it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(df: DataFrame, order: list, name: str, extra: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `row_no`, gapless from 0 in `order`, and for each of `extra` its sum over all rows before.

    Range partitions, a number within each, and the sums of the partitions before: one shuffle of
    the rows; what is broadcast has a row per partition. Ties in `order` are numbered in some order
    that is fixed once the rows are staged. `df` should be narrow; what `drop` names only sorts.
    """
    extra = extra or {}
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = stage(placed.drop(*drop), name)
    totals = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t_{k}") for k, c in extra.items()]
    )
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    sums = {"row_no": "_rows", **{k: f"_t_{k}" for k in extra}}
    starts = totals.select(
        "_part", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_b_{k}") for k, c in sums.items()]
    )
    out = placed.join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_in_part") + F.col("_b_row_no"))
    w = Window.partitionBy("_part").orderBy("_in_part").rowsBetween(Window.unboundedPreceding, -1)
    for k, c in extra.items():
        out = out.withColumn(k, F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("_part", "_in_part", *[f"_b_{k}" for k in sums])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long): rows (node, root), root the smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then follows
    labels twice (pointer jumping), so chains shorten geometrically. Every round is staged; only the
    number of changed rows comes to the driver. Hubs are handled by map-side minima and by
    joins that adaptive execution can split.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "cc-labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        took = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        took = stage(took, "cc-took")
        jump = took.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = took.join(jump, "root").select("node", "old", F.col("up").alias("root"))
        labels = stage(after, "cc-labels")
        if not labels.where("old <> root").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
