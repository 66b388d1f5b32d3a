"""De-duplication and merging, with every tie decided by an explicit order.

Merges are aggregates (map-side combined), so a key that very many rows share costs little; only
first-seen rows keep whole rows, through a minimum over a struct, not a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


def first_seen(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in `order`; `order` should tell all rows of a key apart."""
    rest = [c for c in df.columns if c not in by and c not in order]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in by else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def last_seen(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by and c not in order]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in by else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def harvested(links: DataFrame) -> DataFrame:
    """Links (url, title, score, tag, is_pdf, ord) by canonical address.

    The best score, KNOWN before NEW before none, the longest title (the first of equals), the best
    representative address, and how many addresses there were.
    """
    tag_rank = F.when(F.col("tag") == "KNOWN", 2).when(F.col("tag") == "NEW", 1).otherwise(0)
    return (
        links.withColumn("key", keys.canonical_url(F.col("url")))
        .groupBy("key")
        .agg(
            F.max("score").alias("score"),
            F.bool_or("is_pdf").alias("is_pdf"),
            F.max(tag_rank).alias("tag_rank"),
            F.max_by("title", F.struct(F.length("title"), -F.col("ord"))).alias("title"),
            F.min(keys.url_rank(F.col("url"))).alias("best"),
            F.count_distinct("url").alias("n_variants"),
        )
        .select(
            "key", "score", "is_pdf", F.when(F.col("tag_rank") == 2, "KNOWN").when(F.col("tag_rank") == 1, "NEW").alias("tag"),
            "title", F.col("best.url").alias("url"), "n_variants",
        )
    )


def best_wins(df: DataFrame, by: str, score: str, order: str, keep: list[str], fill: list[str], sticky: Column) -> DataFrame:
    """One row a key: `keep` of the best score (the earliest of equals), the first non-null of `fill` by `order`, `sticky` if any row has it."""
    return df.groupBy(by).agg(
        F.max_by(F.struct(score, *keep), F.struct(F.col(score), -F.col(order))).alias("_best"),
        F.bool_or(sticky).alias("known"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fill],
        F.count(F.lit(1)).alias("n_merged"),
    ).select(by, *[F.col(f"_best.`{c}`").alias(c) for c in (score, *keep)], "known", *fill, "n_merged")


def known_first(df: DataFrame, known: Column, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """All known rows, and the best `budget` of the others.

    Only the others are ranked, and a bound on their rank lets each task keep its best before the shuffle.
    """
    marked = df.withColumn("_known", F.coalesce(known, F.lit(False)))
    w = Window.partitionBy(*by).orderBy(*order)
    others = marked.where(~F.col("_known")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget).drop("_n")
    return marked.where("_known").unionByName(others).drop("_known")


def missing_from(df: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    return df.join(stored.select(*by), by, "left_anti")


def unique_ids(df: DataFrame, by: list[str], id_col: str, order: list[str]) -> DataFrame:
    """A repeated id gets ~2, ~3 ... in order."""
    n = F.row_number().over(Window.partitionBy(*by, id_col).orderBy(*order))
    return df.withColumn("_n", n).withColumn(
        id_col, F.when(F.col("_n") > 1, F.concat(F.col(id_col), F.lit("~"), F.col("_n").cast("string"))).otherwise(F.col(id_col))
    ).drop("_n")
