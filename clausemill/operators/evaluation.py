"""Evaluation: ranks against gold, pools, buckets, intrinsic checks, repeated passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded(ranks: DataFrame, gold: DataFrame, by: list[str], item: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row: hits at each k, mean reciprocal rank and recall over the queries that have gold.

    `ranks` has (by, item, rank), `gold` has (by, item).
    """
    met = gold.join(ranks, [*by, item], "left")
    first = met.groupBy(*by).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("wanted"), F.count("rank").alias("found"))
    return first.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("first") <= k).alias(f"hit{k}") for k in ks],
        F.round(F.coalesce(F.sum(1.0 / F.col("first")), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mrr"),
        F.round(F.try_divide(F.sum("found").cast("double"), F.sum("wanted")), 6).alias("recall"),
    )


def pooled(rankings: DataFrame, by: list[str], item: str, method: str = "method") -> DataFrame:
    """Items that any method ranked: how many did, each method's best rank, and the best of all."""
    one = rankings.groupBy(*by, item, method).agg(F.min("rank").alias("rank"))
    return one.groupBy(*by, item).agg(
        F.count(F.lit(1)).alias("n_methods"),
        F.min("rank").alias("best"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", method, F.col("rank").cast("string")))), ",").alias("ranks"),
    )


def hidden(ranks: DataFrame, gold: DataFrame, by: list[str], item: str, shown: int = 5) -> DataFrame:
    """Gold by where it is: shown, in the pool but below, or not in the pool."""
    met = gold.join(ranks.groupBy(*by, item).agg(F.min("rank").alias("rank")), [*by, item], "left")
    place = F.when(F.col("rank").isNull(), "out of pool").when(F.col("rank") <= shown, "shown").otherwise("below")
    return met.withColumn("place", place)


def bucketed(gold: DataFrame, kept: DataFrame, truncated: DataFrame, secondary: DataFrame, name: str) -> DataFrame:
    """Gold names as kept, truncated, secondary or not found, the first that holds."""
    mark = lambda df, m: df.select(name).distinct().withColumn(m, F.lit(True))
    out = gold.join(mark(kept, "_k"), name, "left").join(mark(truncated, "_t"), name, "left").join(mark(secondary, "_s"), name, "left")
    bucket = F.when(F.col("_k"), "kept").when(F.col("_t"), "truncated").when(F.col("_s"), "secondary").otherwise("not_found")
    return out.withColumn("bucket", bucket).drop("_k", "_t", "_s")


def intrinsic(clauses: DataFrame, texts: DataFrame, document_id: str = "document_id") -> DataFrame:
    """By document: clauses, shares of unique ids and verbatim quotes, and share of the text that clauses cover (in percent, one place)."""
    whole = texts.select(document_id, F.col("text").alias("_whole"))
    ok = F.substring(F.col("_whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    pct = lambda a, b: F.coalesce(F.round(F.try_divide(100.0 * a, b), 1), F.lit(0.0))
    n = F.count("clause_id")
    return whole.join(clauses, document_id, "left").groupBy(document_id).agg(
        n.alias("clauses"),
        pct(F.count_distinct("clause_id"), n).alias("unique"),
        pct(F.count_if(ok), n).alias("verbatim"),
        pct(F.sum(F.col("char_end") - F.col("char_start")), F.max(F.length("_whole"))).alias("covered"),
    )


def discovery_scores(targets: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """By mode: queries, those whose target is among the first k, and those that did as expected (some are meant to miss)."""
    met = targets.join(results.where(F.col("rank") <= k), ["query", "name"], "left").groupBy("query", "name", "mode", "expect_miss").agg(F.count("rank").alias("hits"))
    hit = F.col("hits") > 0
    return met.groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), F.count_if(hit).alias("found"), F.count_if(hit != F.col("expect_miss")).alias("as_expected"))


def united(passes: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """Indicators that any pass found, and whether any pass succeeded (a null verdict is a failed pass)."""
    return passes.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(verdict)))).alias(verdict), (F.count(verdict) > 0).alias("succeeded")
    )


def fallback_reasons(rows: DataFrame, reasons: str) -> DataFrame:
    """How often each set of reasons occurred."""
    return rows.groupBy(F.array_join(F.array_sort(reasons), "+").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def blind(rows: DataFrame, seed: Column, ident: Column, by: list[str]) -> DataFrame:
    """A reproducible order in each group that gives nothing away."""
    w = Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", seed.cast("string"), ident.cast("string")).cast("binary"), 256))
    return rows.withColumn("place", F.row_number().over(w))
