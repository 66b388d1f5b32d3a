"""Reports: grids, gaps, confusion, health, agreement, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..session import small


def dense_grid(rows: DataFrame, columns: DataFrame, counts: DataFrame, by: list[str], count: str) -> DataFrame:
    """Every row with every column, 0 where nothing was counted. The result is that product; the columns are broadcast where they are few."""
    return rows.crossJoin(small(columns)).join(counts, by, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def name_gaps(wanted: DataFrame, found: DataFrame, want: str, have: str) -> DataFrame:
    """Names of three characters or more that contain none of the found ones and are contained in none.

    A name that lies in another shares its first three characters with some three of the other's, which
    makes an equi-join of what would be a comparison of all with all; `contains` then decides.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    w = wanted.select(F.lower(want).alias("w")).where("length(w) >= 3").distinct()
    h = found.select(F.lower(have).alias("h")).where("length(h) >= 3").distinct()
    w_in = w.withColumn("g", F.explode(grams(F.col("w"))))
    h_in = h.withColumn("g", F.explode(grams(F.col("h"))))
    first_w, first_h = w.withColumn("g", F.element_at(grams(F.col("w")), 1)), h.withColumn("g", F.element_at(grams(F.col("h")), 1))
    w_inside = first_w.join(h_in, "g").where(F.contains("h", F.col("w")))
    h_inside = first_h.join(w_in, "g").where(F.contains("w", F.col("h")))
    met = w_inside.select("w").union(h_inside.select("w")).distinct()
    return wanted.withColumn("_w", F.lower(want)).join(met.withColumnRenamed("w", "_w"), "_w", "left_anti").drop("_w")


def confusion(gold: DataFrame, predicted: DataFrame, by: list[str], cell: list[str]) -> DataFrame:
    """True and false positives and misses of cells, by group."""
    both = gold.select(*by, *cell, F.lit(1).alias("_gold")).join(predicted.select(*by, *cell, F.lit(1).alias("_said")), [*by, *cell], "full")
    counts = both.groupBy(*by).agg(
        F.count_if(F.col("_gold").isNotNull() & F.col("_said").isNotNull()).alias("tp"),
        F.count_if(F.col("_gold").isNull()).alias("fp"),
        F.count_if(F.col("_said").isNull()).alias("fn"),
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), 6)
    return counts.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def multi_hit(hits: DataFrame, provision: list[str], indicator: str, least: int = 2) -> DataFrame:
    """Provisions that several indicators cite, numbered in order."""
    groups = hits.groupBy(*provision).agg(F.array_join(F.array_sort(F.collect_set(indicator)), ",").alias("indicators"), F.count_distinct(indicator).alias("n"))
    return groups.where(F.col("n") >= least)


def co_occurrence(hits: DataFrame, provision: list[str], indicator: str) -> DataFrame:
    """Counts of unordered pairs of indicators on a provision; an indicator set is as small as the catalogue."""
    sets = hits.groupBy(*provision).agg(F.array_sort(F.collect_set(indicator)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, decided: Column, agrees: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(decided).alias("decided"), F.count_if(decided & agrees).alias("agreed")).withColumn(
        "rate", F.round(F.try_divide(F.col("agreed").cast("double"), F.col("decided")), 6)
    )


def stability(passes: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """Whether all passes gave the same verdict."""
    return passes.groupBy(*by).agg((F.count_distinct(verdict) == 1).alias("stable"))


def priced(usage: DataFrame, rates: DataFrame, model: str, cost: Column, by: list[str]) -> DataFrame:
    """Sums by group; the cost is null as soon as one model in it has no rate."""
    rated = usage.join(rates, model, "left").withColumn("_cost", cost)
    return rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.when(F.every(F.col("_cost").isNotNull()), F.round(F.sum("_cost"), 6)).alias("cost"),
        F.count_if(F.col("_cost").isNull()).alias("unpriced"),
    )


def merged_intervals(boxes: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping intervals."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = boxes.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    grouped = opened.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


NOTHING = "NO PROVISION FOUND"


def lookup(rows: DataFrame, scope: DataFrame, by: list[str], answer: str) -> DataFrame:
    """The rows of each cell in `scope` (by), case aside; a cell without any says so: an empty cell is a finding."""
    low = [F.lower(F.col(c)) for c in by]
    found = rows.withColumns({f"_{c}": x for c, x in zip(by, low)}).drop(*by)
    out = scope.select(*by).distinct().join(found, [F.lower(F.col(c)) == F.col(f"_{c}") for c in by], "left")
    return out.withColumn(answer, F.coalesce(answer, F.lit(NOTHING))).drop(*[f"_{c}" for c in by])


def section_blocks(clauses: DataFrame, by: list[str], section: str = "section", order: str = "ord", text: str = "text", most: int | None = 90) -> DataFrame:
    """A statute as lines of a prompt, "section: text", in order: the openings of sections (`most` characters), or their whole texts (None)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, collapse(F.col(text)).alias("t")))), lambda x: x["t"])
    each = clauses.groupBy(*by, section).agg(F.min(order).alias("_at"), parts.alias("_parts"))
    body = F.array_join("_parts", " ") if most is None else F.substring(F.get("_parts", 0), 1, most)
    line = F.concat(F.col(section), F.lit(": "), body)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", line.alias("l")))), lambda x: x["l"])
    return each.groupBy(*by).agg(F.array_join(lines, "\n").alias("block"))


def retrieval_method(dense: Column, judge: Column, review_status: Column) -> Column:
    """How a row was found: bm25[+dense][+llm-<judge>][+llm-flagged]."""
    lane = F.when(judge != "", F.concat(F.lit("+llm-"), F.replace(judge, F.lit("_"), F.lit("-")))).otherwise("")
    flagged = F.when(review_status == "CONFLICT_REVIEW", "+llm-flagged").otherwise("")
    return F.concat(F.when(dense, "bm25+dense").otherwise("bm25"), lane, flagged)


# What a self-screen's verdict makes a reviewer expect, and whose sheet a file is.
EXPECTED = {"LIKELY-OK": "KEEP", "LIKELY-WRONG": "DROP"}
SHEET_ISO = r"_(my|sg|au)\b"


def expected_verdict(self_verdict: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    return F.coalesce(F.try_element_at(known, self_verdict), F.lit("EITHER"))


def pillar_of(indicator: Column) -> Column:
    return F.split_part(indicator, F.lit("-"), F.lit(1))


def sheet_iso(file_stem: Column) -> Column:
    found = F.regexp_extract(file_stem, SHEET_ISO, 1)
    return F.when(found == "", "??").otherwise(found)


def suggestions(told: DataFrame, clauses: DataFrame, by: list[str], section: str = "section") -> DataFrame:
    """A model's sections for each indicator, those that the statute has: the others are made up."""
    return told.join(clauses.select(*by, section).distinct(), [*by, section], "left_semi")


def answer_block(indicator: Column, name: Column, n_candidates: Column) -> Column:
    """What a reviewer fills in for an indicator."""
    return F.format_string("### %s %s\ncandidates: %d\nVERDICT: KEEP/DROP\nNOTE:\n", indicator, name, n_candidates)


def document_by_content(documents: DataFrame, needles: DataFrame, by: str = "iso") -> DataFrame:
    """For each request (by, needles array) the longest document (by, document_id, head, n_pages) whose first pages hold all needles, case aside."""
    met = documents.join(needles, by).where(F.forall("needles", lambda n: F.contains(F.upper("head"), F.upper(n))))
    return met.groupBy(by, "needles").agg(F.max_by("document_id", F.struct("n_pages", "document_id")).alias("document_id"))
