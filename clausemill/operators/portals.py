"""What portals answer, as tables: amending acts, child regulations, record groups, parts of a book, dead links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small


def amending_acts(versions: DataFrame, limit: int = 40) -> DataFrame:
    """Acts that amended a title, from versions (title_id, version_ord, reasons array<struct<affect, act_id, act_title, year>>).

    The last mention of an act holds; the newest acts come first.
    """
    each = versions.select("title_id", "version_ord", F.posexplode("reasons").alias("k", "r")).where("r.affect = 'Amend' and r.act_id is not null")
    last = each.groupBy("title_id", "r.act_id").agg(F.max_by("r", F.struct("version_ord", "k")).alias("r"))
    w = Window.partitionBy("title_id").orderBy(F.col("r.year").desc_nulls_last(), "act_id")
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("title_id", "act_id", "r.act_title", "r.year", "place")


def child_regulations(acts: DataFrame, titles: DataFrame, authorised: DataFrame, limit: int = 20) -> DataFrame:
    """Titles that carry an act's name and that the register says it authorised.

    `acts` is (act_id, stem), `titles` (title_id, name), `authorised` the edges (title_id, act_id): the edges
    are the join, the name confirms them.
    """
    met = authorised.join(acts, "act_id").join(titles, "title_id").where(F.contains(F.lower("name"), F.lower("stem")))
    w = Window.partitionBy("act_id").orderBy("name", "title_id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("stem")


def grouped_records(records: DataFrame) -> DataFrame:
    """Search records (query, act_id, idx, span, principal, title, fulltext, url) as one row an act.

    Relevance falls with the place in the answer; the longest title and the first full text stay.
    """
    relevance = F.greatest(F.lit(0.0), 1.0 - F.col("idx") / F.greatest(F.col("span"), F.lit(1)))
    return records.withColumn("_rel", relevance).groupBy("query", "act_id").agg(
        F.max("_rel").alias("relevance"),
        F.bool_or("principal").alias("principal"),
        F.max_by("title", F.struct(F.length("title"), -F.col("idx"))).alias("title"),
        F.min_by("fulltext", F.when(F.col("fulltext").isNotNull(), F.col("idx"))).alias("fulltext"),
        F.min_by("url", F.struct(~F.col("principal"), F.col("idx"))).alias("url"),
        F.count(F.lit(1)).alias("n_records"),
    )


def spliced(parts: DataFrame, most: int = 50, least_bytes: int = 200) -> DataFrame:
    """A book's parts (book, part_no, status, body) joined in order, up to the first that is missing or broken."""
    good = parts.where((F.col("status") == 200) & (F.length("body") >= least_bytes) & (F.col("part_no") <= most))
    in_order = good.withColumn("_n", F.row_number().over(Window.partitionBy("book").orderBy("part_no"))).where(F.col("_n") == F.col("part_no"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "body"))), lambda x: x["body"])
    return in_order.groupBy("book").agg(F.array_join(bodies, "\n").alias("body"), F.count(F.lit(1)).alias("n_parts"))


def with_dead_links(citations: DataFrame, probes: DataFrame, url: str = "source_url", notes: str = "notes") -> DataFrame:
    """Citations whose address did not answer say so; `probes` is (url, status), an address once."""
    p = probes.select(F.col("url").alias(url), F.col("status").alias("_status"))
    dead = F.col("_status").isNull() | ~F.col("_status").between(200, 399)
    note = F.when(F.col("_asked") & dead, F.concat(F.lit("Source link did not answer ("), F.coalesce(F.col("_status").cast("string"), F.lit("no response")), F.lit(").")))
    out = citations.join(p.withColumn("_asked", F.lit(True)), url, "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    return out.withColumn(notes, F.concat_ws(" ", F.when(F.col(notes) != "", F.col(notes)), note)).drop("_status", "_asked")


def specialised_else_generic(special: DataFrame, generic: DataFrame, portal: str) -> DataFrame:
    """A portal's own strategy where it gave anything, the generic harvest elsewhere."""
    return special.unionByName(generic.join(special.select(portal).distinct(), portal, "left_anti"))


def retry_queue(answers: DataFrame) -> DataFrame:
    """Refused queries, each once, in the order in which they were asked."""
    return answers.where(F.col("outcome").isin("BLOCKED", "UNRENDERED")).groupBy("portal", "query").agg(F.min("ord").alias("ord")).orderBy("ord")


def guidance(links: DataFrame, wanted: Column) -> DataFrame:
    """Regulators' documents among links (href, anchor_text): each address once, with its longest title."""
    return links.where(wanted).groupBy("href").agg(F.max_by("anchor_text", F.struct(F.length("anchor_text"), -F.col("ord"))).alias("title"))


def strategy_for(portals: DataFrame, strategies: DataFrame, host: str = "host") -> DataFrame:
    """The first strategy (needle, ord, strategy) whose needle a portal's host contains; null for none.

    Strategies are a short list that a build ships with.
    """
    met = portals.join(small(strategies), F.contains(F.lower(host), F.lower("needle")), "left")
    first = F.min_by("strategy", F.when(F.col("needle").isNotNull(), F.col("ord")))
    return met.groupBy(*portals.columns).agg(first.alias("strategy"))


def worksheet(lines: DataFrame, sheet: str = "sheet", order: str = "ord", line: str = "line") -> DataFrame:
    """Cells (sheet, instrument, indicator, verdict, note) of reviewers' sheets.

    A heading names an instrument, another an indicator of it; verdicts and notes below belong to the last
    indicator; DROP-ALL drops all of an instrument. What a line belongs to is carried forward in order.
    """
    so_far = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    text = F.col(line)
    instrument = F.when(text.rlike(r"^##\s+\S"), F.trim(F.regexp_extract(text, r"^##\s+(.*)$", 1)))
    indicator = F.when(text.rlike(r"^\s*###\s*P[0-9]+-I[0-9]+"), F.regexp_extract(text, r"(P[0-9]+-I[0-9]+)", 1))
    marked = lines.withColumn("instrument", F.last(instrument, ignorenulls=True).over(so_far)).withColumn("_new", instrument.isNotNull()).withColumn("_ind", indicator)
    within = Window.partitionBy(sheet, "instrument").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = marked.withColumn("indicator", F.last("_ind", ignorenulls=True).over(within)).where("instrument is not null")
    said = F.upper(F.regexp_extract(text, r"(?i)VERDICT\s*[:=]\s*(KEEP|DROP)\b(?!\s*/)", 1))
    rows = held.withColumn("_all", F.contains(text, F.lit("DROP-ALL"))).withColumn("_said", F.when(said != "", said)).withColumn(
        "_note", F.when(text.rlike(r"(?i)NOTE\s*:\s*\S"), F.trim(F.regexp_extract(text, r"(?i)NOTE\s*:\s*(.*)$", 1)))
    )
    dropped = rows.groupBy(sheet, "instrument").agg(F.bool_or("_all").alias("_drop"))
    cells = rows.where("indicator is not null").groupBy(sheet, "instrument", "indicator").agg(
        F.min(order).alias(order), F.max_by("_said", F.when(F.col("_said").isNotNull(), F.col(order))).alias("verdict"), F.max_by("_note", F.when(F.col("_note").isNotNull(), F.col(order))).alias("note")
    )
    out = cells.join(dropped, [sheet, "instrument"])
    return out.select(sheet, "instrument", "indicator", order, F.when(F.col("_drop"), "DROP-ALL").otherwise(F.coalesce("verdict", F.lit(""))).alias("verdict"), F.coalesce("note", F.lit("")).alias("note"))
