"""Queries that compose operators: pages to blocks, texts to clauses, clauses to citations, names to identities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import citations, currency, discovery, evaluation, retrieval, rules, structure
from ..session import shared_dir
from ..sources import html, sinks
from ..streaming import events as streams
from .retrieval import _BM25, _scored, _texts_of, quoted, read


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.blocks(read(spark, sf, "pages"), "page_id").select(F.col("page_id").cast("long").alias("page_id"), "block_no", "dom_anchor", "text", "char_start", "char_end")


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    found = html.links(read(spark, sf, "pages"), "page_id")
    return found.where(~rules.chrome(F.col("href"), F.col("anchor_text")) & ~rules.navigation_label(F.col("anchor_text"))).select(
        F.col("page_id").cast("long").alias("page_id"), "ord", "href", "anchor_text"
    )


def _statutes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as statutes: each line a numbered section, some of two subsections, after a schedule heading for every seventh."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    section = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.when(i % 3 == 0, "\n(2) also so.\n").otherwise("\n"))
    body = F.array_join(F.transform(lines, section), "")
    tail = F.when(F.col("doc_id") % 7 == 0, "Schedule 1—Forms\n1. A form.\n").otherwise("")
    return read(spark, sf, "documents").select(F.concat(F.lit("x:"), F.col("doc_id").cast("string")).alias("document_id"), F.concat(body, tail).alias("text"))


def statute_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return structure.parse(_statutes(spark, sf))


def statute_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses, held against texts read anew: how many quote them word for word, and how many have an id of their own."""
    found = evaluation.intrinsic(structure.parse(_statutes(spark, sf)), _statutes(spark, sf))
    share = lambda c: F.round(F.sum(F.col(c) * F.col("clauses")) / F.sum("clauses"), 1)
    return found.agg(F.sum("clauses").alias("n"), share("verbatim").alias("verbatim"), share("unique").alias("unique"))


def _by_length(texts: list[str]) -> list[list[str] | None]:
    """A judge for queries and tests: what it finds depends on the length of the text; it fails on every 13th."""
    return [None if len(t) % 13 == 0 else [f"I{k}" for k in (1, 2, 3) if len(t) % (k + 2) == 0] for t in texts]


def _lane_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The 40 best clauses of each source for each indicator, with their texts."""
    top = retrieval.top_k(_scored(spark, sf), ["corpus", "indicator"], [F.col("score").desc(), F.col("doc_id"), F.col("line_no")], 40)
    return _texts_of(spark, sf, top.drop("rank", "opening")).withColumn("text", quoted()).drop("whole", "char_start", "char_end")


def judged_lane(spark: SparkSession, sf: str) -> DataFrame:
    hits = _lane_inputs(spark, sf)
    by = ["corpus", "doc_id", "line_no"]
    pool = hits.select(*by, "text").distinct()
    verdicts = citations.judged(pool, _by_length, None, "m", "f")
    return citations.clause_lane(hits.drop("text"), verdicts, by).select(*by, "indicator", "score", F.round("confidence", 6).alias("confidence"))


def ranking_lane(spark: SparkSession, sf: str) -> DataFrame:
    hits = _lane_inputs(spark, sf)
    ordered = hits.withColumn("ord", F.struct("doc_id", "line_no"))
    out = citations.ranking_lane(ordered, ["corpus", "indicator"], 0.01, 0.6, 3)
    return out.select("corpus", "indicator", "doc_id", "line_no", "rank", F.round("norm", 6).alias("norm"))


def review_statuses(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    claims = d.select(
        "doc_id", F.col("text").alias("span_text"),
        F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("  "), "text")).otherwise(F.col("text")).alias("quote"),
        (F.col("doc_id") % 17 != 0).alias("primary"), F.when(F.col("doc_id") % 4 == 0, 0.8).alias("ocr_confidence"), F.when(F.col("doc_id") % 6 == 0, "uncertain").otherwise("match").alias("label"),
    )
    return citations.validated(claims).groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))


def known_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """All parts, by name and type, against the names that one brand knows, by token sets."""
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"))
    known = read(spark, sf, "part").where("p_brand = 'Brand#2'").groupBy(F.concat(F.lit("the "), F.col("p_name")).alias("name")).agg(F.min("p_partkey").alias("ord"))
    return discovery.tagged(parts, known).select("id", F.round("ratio", 6).alias("ratio"), F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("matched", F.lit("")).alias("matched"))


def _amending(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    n = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("An Act to amend the Data Act "), (1990 + F.col("o_orderkey") % 30).cast("string"), F.lit(". "))).otherwise("An Act about data. "),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Incorporating all amendments up to "), (2000 + F.col("o_orderkey") % 20).cast("string"), F.lit(". "))).otherwise(""),
        F.lit("Section "), n, F.lit(" of the principal Act is "), F.when(F.col("o_orderkey") % 2 == 0, "repealed").otherwise("amended"),
        F.when(F.col("o_orderkey") % 5 == 0, " and the following substituted: new words.").otherwise("."),
        F.lit(" Section 9A of the principal Act is deleted. By inserting after section 7 the following."),
    )
    return o.select(F.col("o_orderkey").alias("key"), text.alias("text"))


def amendment_instructions(spark: SparkSession, sf: str) -> DataFrame:
    return currency.instructions(_amending(spark, sf)).select("key", "ord", "kind", "op", "target_section")


def version_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _amending(spark, sf).select(
        "key", currency.version_kind(t).alias("kind"), F.coalesce(currency.incorporated_to(t), F.lit(0)).alias("year"), F.coalesce(currency.amends_target(t)["title"], F.lit("")).alias("target")
    )


def json_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.substring("text", 10, 20).alias("quote"), F.col("text").alias("whole"))
    lines = sinks.json_lines(d, "whole", 5)
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.md5(F.get_json_object("value", "$.context").cast("binary")).alias("context"))


def streamed_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """The tumbling counts by a stream that is run to its end."""
    shared = shared_dir(spark)
    name = f"tumbling_{uuid.uuid4().hex}"
    found = read(spark, sf, "events")
    found.write.parquet(f"{shared}/{name}-events")  # a stream reads a folder
    counts = streams.tumbling(streams.read_events(spark, f"{shared}/{name}-events", found.schema), "1 hour", "1 day", ["event_type"])
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


_ALL = (
    html_blocks, html_links, statute_clauses, statute_verbatim, judged_lane, ranking_lane, review_statuses, known_by_name, amendment_instructions, version_kinds,
    json_sidecar, streamed_tumbling,
)
QUERIES = {f.__name__: f for f in _ALL}
_TOP = f"""{_BM25}, k AS (SELECT corpus, doc_id, line_no, indicator, round(score, 6) AS score, row_number() OVER (PARTITION BY corpus, indicator ORDER BY round(score, 6) DESC, doc_id, line_no) AS r FROM s QUALIFY r <= 40),
h AS (SELECT k.*, c.text FROM k JOIN c USING (corpus, doc_id, line_no))"""
_CHROME = " OR ".join(f"contains(lower(href || ' ' || t), '{m}')" for m in rules.CHROME)
ORACLE_SQL = {
    "html_links": rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS h, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t,
  unnest(generate_series(0, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) - 1)) AS ord FROM pages),
f AS (SELECT page_id, ord, base || h AS href, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM l)
SELECT page_id, CAST(ord AS INTEGER) AS ord, href, t AS anchor_text FROM f WHERE NOT ({_CHROME}) AND regexp_replace(lower(t), '\.+$', '') NOT IN ({', '.join(repr(w.rstrip('.')) for w in rules.NAVIGATION)})""",
    "statute_verbatim": """WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS x, unnest(generate_series(0, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) - 1)) AS i FROM documents),
d AS (SELECT doc_id, count(*) + count(*) FILTER (i % 3 = 0) + (doc_id % 7 = 0)::INTEGER AS clauses, count(*) + (doc_id % 7 = 0)::INTEGER AS heads,
  sum(length(CAST(i + 1 AS VARCHAR)) + 2 + length(x) + CASE WHEN i % 3 = 0 THEN 14 ELSE 1 END) + CASE WHEN doc_id % 7 = 0 THEN 28 ELSE 0 END AS chars FROM l GROUP BY doc_id)
SELECT CAST(sum(clauses) AS BIGINT) AS n, CAST(100 AS DOUBLE) AS verbatim, CAST(100 AS DOUBLE) AS "unique" FROM d WHERE chars / heads <= 12000""",
    "judged_lane": f"""{_TOP}, v AS (SELECT corpus, doc_id, line_no, max(score) AS best, any_value(text) AS text FROM h GROUP BY 1, 2, 3 HAVING length(any_value(text)) % 13 <> 0),
w AS (SELECT v.*, n.indicator FROM v JOIN (VALUES ('I1', 3), ('I2', 4), ('I3', 5)) AS n(indicator, m) ON length(text) % m = 0)
SELECT w.corpus, w.doc_id, CAST(w.line_no AS INTEGER) AS line_no, w.indicator, coalesce(k.score, best) AS score, round(greatest(0, least(1, tanh(coalesce(k.score, best) / 40))), 6) AS confidence
FROM w LEFT JOIN k ON k.corpus = w.corpus AND k.doc_id = w.doc_id AND k.line_no = w.line_no AND k.indicator = w.indicator""",
    "ranking_lane": f"""{_TOP}, a AS (SELECT *, row_number() OVER (PARTITION BY corpus, indicator ORDER BY score DESC, doc_id, line_no) AS rank FROM h QUALIFY rank <= 3),
g AS (SELECT *, greatest(0, least(1, tanh(score / 40))) AS norm FROM a WHERE greatest(0, least(1, tanh(score / 40))) >= CAST(0.01 AS DOUBLE)),
x AS (SELECT *, first_value(norm) OVER (PARTITION BY corpus, indicator ORDER BY rank) AS best, row_number() OVER (PARTITION BY corpus, indicator ORDER BY rank) AS place FROM g)
SELECT corpus, indicator, doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(rank AS INTEGER) AS rank, round(norm, 6) AS norm FROM x WHERE place = 1 OR norm >= CAST(0.6 AS DOUBLE) * best""",
    "review_statuses": """SELECT CASE WHEN doc_id % 17 = 0 THEN 'NO_PRIMARY_SOURCE_FOUND' WHEN doc_id % 4 = 0 THEN 'LOW_OCR_CONFIDENCE' WHEN doc_id % 10 = 0 THEN 'X' WHEN doc_id % 6 = 0 THEN 'CONFLICT_REVIEW' ELSE 'VERIFIED' END AS review_status, count(*) AS n
FROM documents GROUP BY 1 HAVING review_status <> 'X'""",
    "amendment_instructions": """WITH o AS (SELECT o_orderkey AS key FROM orders)
SELECT key, 0 AS ord, 'SECTION_OP' AS kind, CASE WHEN key % 2 <> 0 THEN 'amend' WHEN key % 5 = 0 THEN 'substitute' ELSE 'delete' END AS op, CAST(key AS VARCHAR) AS target_section FROM o
UNION ALL SELECT key, 1, 'SECTION_OP', 'delete', '9A' FROM o UNION ALL SELECT key, 2, 'SECTION_OP', 'insert', '7' FROM o""",
    "version_kinds": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'AMENDMENT_DELTA' WHEN o_orderkey % 4 = 0 THEN 'CONSOLIDATED' ELSE 'ORIGINAL' END AS kind, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2000 + o_orderkey % 20 ELSE 0 END AS INTEGER) AS year,
CASE WHEN o_orderkey % 3 = 0 THEN 'Data Act ' || (1990 + o_orderkey % 30) ELSE '' END AS target FROM orders""",
    "json_sidecar": "WITH q AS (SELECT doc_id, text, substring(text, 10, 20) AS quote FROM documents), p AS (SELECT *, strpos(text, quote) AS p FROM q) SELECT doc_id, md5(CASE WHEN length(quote) > 0 THEN substring(text, greatest(p - 5, 1), p - greatest(p - 5, 1) + length(quote) + 5) ELSE '' END) AS context FROM p",
    "streamed_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
