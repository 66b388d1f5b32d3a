"""The pipeline's verbs: from texts and a catalogue to citations that are current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, scoring, text as X
from ..operators import citations, currency, evaluation, merge, portals, retrieval, rules, structure, telemetry
from ..session import stage
from ..sources import console
from .lanes import _statutes
from .retrieval import indicators, read


def retrieve(clauses: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """Each indicator's best clauses of every document, which is a corpus of its own; openings that state no rule are left out after scoring."""
    corpus = clauses.withColumn("corpus", F.col("document_id")).withColumn("opening", rules.boilerplate(F.col("text")))
    places = ["clause_id", "clause_ord", "structural_path", "char_start", "char_end", "opening"]
    scores = retrieval.bm25(corpus, catalogue, places).withColumn("score", F.round("score", 9)).where(~F.col("opening")).drop("opening")
    top = retrieval.top_k(scores, ["corpus", "indicator"], [F.col("score").desc(), F.col("clause_ord")], k)
    return top.withColumnRenamed("corpus", "document_id").join(clauses.select("document_id", "clause_id", "text"), ["document_id", "clause_id"])


def cite(
    documents: DataFrame, catalogue: DataFrame, judge: citations.Judge | str | None = None, k: int = 3, min_score: float = 0.35, rel_floor: float = 0.6,
    stored: DataFrame | None = None, model: str = "judge", pool: int = 40,
) -> DataFrame:
    """Citations of documents (document_id, text, title, source_url, economy, primary, status) for a catalogue (indicator, query).

    With a judge, its verdicts decide, those that `stored` (key, verdict) has without asking; a document most of whose
    clauses it failed on falls back to the ranking lane, above the degraded floor, and `lane` says so. Without one the ranking decides.
    """
    live = documents.where(rules.enforced(rules.merged_status(F.col("status"), rules.lifecycle(F.col("title"), F.col("text")))))
    clauses = structure.parse(live)
    judge = citations.judge_of(judge)
    hits = retrieve(clauses, catalogue, k if judge is None else pool)
    ranked = citations.ranking_lane(hits.withColumn("ord", F.col("clause_ord")).drop("rank"), ["document_id", "indicator"], min_score, rel_floor, k)
    found = ranked.withColumnRenamed("norm", "confidence").drop("rank", "ord", "opening").withColumn("lane", F.lit("RANKED"))
    if judge is not None:
        by = ["document_id", "clause_id"]
        hits, found = stage(hits, "cite-hits"), stage(found, "cite-ranked")
        verdicts = stage(citations.judged(hits.select(*by, "text").distinct(), judge, stored, model, ""), "cite-verdicts")
        places = hits.select(*by, "clause_ord", "structural_path", "char_start", "char_end").distinct()
        said = citations.clause_lane(hits.select(*by, "indicator", "score"), verdicts, by).join(places, by)
        degraded = telemetry.degraded(verdicts, ["document_id"], F.col("verdict").isNull())
        found = citations.with_fallback(said, found.drop("lane"), degraded, "document_id")
    whole = live.select("document_id", F.col("text").alias("_whole"), "title", "source_url", "economy", "primary")
    claims = found.join(whole, "document_id").select(
        "document_id", "clause_id", "indicator", "clause_ord", "structural_path", "char_start", "char_end", "confidence", "lane", "title", "source_url", "economy", "primary",
        F.col("text").alias("span_text"), F.substring(F.col("_whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("quote"),
        F.lit(None).cast("double").alias("ocr_confidence"), F.lit("match").alias("label"),
    )
    return merge.first_seen(citations.validated(claims).drop("span_text", "label"), ["indicator", "clause_id"], ["document_id", "clause_ord"])


def current(cited: DataFrame, documents: DataFrame, amendments: DataFrame) -> DataFrame:
    """Citations with currency, from documents' own claims and amending texts (key, year, amending_id, title, detected_by, ord, text)."""
    facts = documents.select(
        "document_id", currency.incorporated_to(F.col("text")).alias("cutoff"), currency.version_kind(F.col("text")).alias("kind"), X.title_key(F.col("title")).alias("key")
    )
    chain = currency.chain(amendments)
    missed = currency.missed(facts.select("key", "cutoff").distinct(), chain.select("key", "year"))
    with_doc = cited.join(facts, "document_id").join(missed.withColumnRenamed("key", "_k").withColumnRenamed("cutoff", "_c"), (F.col("key") == F.col("_k")) & F.col("cutoff").eqNullSafe(F.col("_c")), "left").drop("_k", "_c")
    coarse = currency.document_status(F.coalesce("n_events", F.lit(0)), F.coalesce("n_missed", F.lit(0)), F.col("kind"))
    ops = currency.instructions(amendments)
    commenced = amendments.groupBy("key").agg(F.every(currency.commenced(F.col("text"))).alias("commenced"))
    asked = with_doc.join(commenced, "key").where("n_missed > 0").select(
        F.concat_ws("|", "indicator", "clause_id").alias("citation"), "key", X.section_of(F.col("structural_path")).alias("section"), "commenced"
    )
    fine = currency.adjudicated(asked, ops).select("citation", F.col("status").alias("_fine"), "amendment_text")
    out = with_doc.withColumn("citation", F.concat_ws("|", "indicator", "clause_id")).withColumn("_coarse", coarse).join(fine, "citation", "left")
    return out.withColumn("currency_status", F.coalesce("_fine", "_coarse")).where("currency_status <> 'REPEALED'").drop("_fine", "_coarse", "citation", "n_events", "n_missed")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    meta = read(spark, sf, "documents").select(
        F.concat(F.lit("x:"), F.col("doc_id").cast("string")).alias("document_id"),
        F.concat(F.lit("Data Act "), (2000 + F.col("doc_id") % 20).cast("string"), F.when(F.col("doc_id") % 13 == 0, " (Repealed)").otherwise("")).alias("title"),
        F.lit("http://x").alias("source_url"), F.upper("lang").alias("economy"), (F.col("doc_id") % 9 != 0).alias("primary"), F.lit("UNKNOWN").alias("status"),
    )
    return _statutes(spark, sf).join(meta, "document_id")


def map_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The whole map: statutes to citations in the ranking lane."""
    cited = cite(_documents(spark, sf), indicators(spark), None, 3, 0.01, 0.6)
    return cited.select("economy", "indicator", "document_id", "clause_id", "structural_path", "quote", F.round("confidence", 6).alias("confidence"), "review_status")


def map_current(spark: SparkSession, sf: str) -> DataFrame:
    """The map with currency: amending texts by title and year."""
    docs = _documents(spark, sf)
    a = read(spark, sf, "orders").select(
        F.concat(F.lit("title:data act "), (2000 + F.col("o_orderkey") % 20).cast("string")).alias("key"), (2005 + F.col("o_orderkey") % 15).cast("int").alias("year"),
        F.concat(F.lit("Act A"), F.col("o_orderkey").cast("string")).alias("amending_id"), F.lit("").alias("title"), F.lit("corpus").alias("detected_by"), F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("Section "), (F.col("o_orderkey") % 7 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " of the principal Act is deleted.").otherwise(" of the principal Act is amended.")).alias("text"),
    )
    out = current(cite(docs, indicators(spark), None, 3, 0.01, 0.6), docs, a)
    return out.groupBy("economy", "currency_status").agg(F.count(F.lit(1)).alias("n"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(
        F.upper("lang").alias("economy"), F.concat(F.lit("P6-I"), (F.col("doc_id") % 4).cast("string")).alias("indicator_id"), F.when(F.col("doc_id") % 3 == 0, "NEW").otherwise("KNOWN").alias("discovery_tag"),
        F.when(F.col("doc_id") % 5 == 0, "CONFLICT_REVIEW").otherwise("VERIFIED").alias("review_status"), F.when(F.col("doc_id") % 2 == 0, "CURRENT").alias("currency_status"),
    )
    return console.summary(d)


def amending_acts(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("title_id"), F.struct(F.col("l_orderkey"), F.col("l_linenumber")).alias("version_ord"),
        F.array(F.struct(F.when(F.col("l_returnflag") == "R", "Amend").otherwise("Repeal").alias("affect"), (F.col("l_partkey") % 200).alias("act_id"), F.concat(F.lit("Act "), (F.col("l_partkey") % 200).cast("string")).alias("act_title"), (1990 + F.col("l_partkey") % 30).cast("int").alias("year"))).alias("reasons"),
    )
    return portals.amending_acts(x, 5).select("title_id", "act_id", "year", "place")


def spliced_parts(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).cast("int").alias("part_no"), F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, 404).otherwise(200).alias("status"), F.col("text").alias("body"))
    return portals.spliced(c, 50, 1).select("book", F.md5(F.col("body").cast("binary")).alias("body"), "n_parts")


def dead_link_notes(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").select("page_id", F.col("url").alias("source_url"), F.when(F.col("page_id") % 2 == 0, "seen").otherwise("").alias("notes"))
    probes = p.where("page_id % 3 = 0").groupBy(F.col("source_url").alias("url")).agg(F.when(F.min("page_id") % 2 == 0, 404).otherwise(200).alias("status"))
    return portals.with_dead_links(p, probes).select("page_id", "notes")


def pooled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("indicator"), (F.col("l_partkey") % 40).alias("section"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("int").alias("rank"))
    return evaluation.pooled(x, ["indicator"], "section")


def graded_ranks(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("q"), (F.col("l_partkey") % 90).alias("item")).agg(F.min("l_linenumber").alias("rank"))
    gold = read(spark, sf, "customer").select((F.col("c_custkey") % 300).alias("q"), (F.col("c_custkey") % 90).alias("item")).distinct()
    return evaluation.graded(x, gold, ["q"], "item")


def blind_order(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.blind(read(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_brand"), F.col("p_partkey"), ["p_brand"])


def fallback_reasons(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("reasons"))
    return evaluation.fallback_reasons(e, "reasons")


def stored_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """What a content-addressed store would write: bodies that it doesn't hold, once each."""
    d = read(spark, sf, "documents").select(keys.content_hash(F.col("text")).alias("sha256"), "doc_id", F.length("text").alias("size"))
    held = d.where("doc_id < 50").select("sha256").distinct()
    return merge.first_seen(merge.missing_from(d, held, ["sha256"]), ["sha256"], ["doc_id"])


def estimated_costs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("lang").agg(F.sum(scoring.estimated_tokens(F.col("text"))).alias("tokens"))


_ALL = (
    map_citations, map_current, run_summary, amending_acts, spliced_parts, dead_link_notes, pooled_candidates, graded_ranks, blind_order, fallback_reasons,
    stored_blobs, estimated_costs,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "run_summary": """WITH d AS (SELECT upper(lang) AS economy, 'P6-I' || (doc_id % 4) AS i, doc_id % 3 = 0 AS new, doc_id % 5 = 0 AS review, CASE WHEN doc_id % 2 = 0 THEN 'CURRENT' ELSE 'UNKNOWN' END AS status FROM documents),
s AS (SELECT economy, string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) AS currency FROM (SELECT economy, status, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT economy, count(*) AS citations, string_agg(DISTINCT i, ',' ORDER BY i) AS indicators, count(*) FILTER (new) AS new, count(*) FILTER (review) AS review, any_value(currency) AS currency FROM d JOIN s USING (economy) GROUP BY economy""",
    "amending_acts": """WITH r AS (SELECT DISTINCT l_orderkey % 50 AS title_id, l_partkey % 200 AS act_id, CAST(1990 + (l_partkey % 30) AS INTEGER) AS y, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
l AS (SELECT title_id, act_id, arg_max(y, l_orderkey * 100 + l_linenumber) AS year FROM r GROUP BY 1, 2)
SELECT title_id, act_id, year, CAST(row_number() OVER (PARTITION BY title_id ORDER BY year DESC, act_id) AS INTEGER) AS place FROM l QUALIFY place <= 5""",
    "spliced_parts": """WITH g AS (SELECT conv_id AS book, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE (conv_id + turn) % 5 <> 4 AND length(text) >= 1)
SELECT book, md5(string_agg(text, chr(10) ORDER BY turn)) AS body, count(*) AS n_parts FROM g WHERE n = turn GROUP BY book""",
    "dead_link_notes": """WITH p AS (SELECT url, CASE WHEN min(page_id) % 2 = 0 THEN 404 ELSE 200 END AS status FROM pages WHERE page_id % 3 = 0 GROUP BY url)
SELECT page_id, concat_ws(' ', CASE WHEN page_id % 2 = 0 THEN 'seen' END, CASE WHEN status = 404 THEN 'Source link did not answer (404).' END) AS notes FROM pages LEFT JOIN p ON p.url = pages.url""",
    "pooled_candidates": """WITH o AS (SELECT l_orderkey % 100 AS indicator, l_partkey % 40 AS section, l_returnflag AS m, CAST(min(l_linenumber) AS INTEGER) AS r FROM lineitem GROUP BY 1, 2, 3)
SELECT indicator, section, count(*) AS n_methods, min(r) AS best, string_agg(m || ':' || r, ',' ORDER BY m || ':' || r) AS ranks FROM o GROUP BY 1, 2""",
    "graded_ranks": """WITH x AS (SELECT l_orderkey % 300 AS q, l_partkey % 90 AS item, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT c_custkey % 300 AS q, c_custkey % 90 AS item FROM customer),
f AS (SELECT q, min(rank) AS first, count(*) AS wanted, count(rank) AS found FROM g LEFT JOIN x USING (q, item) GROUP BY q)
SELECT count(*) AS n, count(*) FILTER (first <= 1) AS hit1, count(*) FILTER (first <= 3) AS hit3, round(coalesce(sum(CAST(1 AS DOUBLE) / first), 0) / greatest(count(*), 1), 6) AS mrr, round(CAST(sum(found) AS DOUBLE) / sum(wanted), 6) AS recall FROM f""",
    "blind_order": "SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_brand || '|' || p_partkey)) AS INTEGER) AS place FROM part",
    "fallback_reasons": "WITH u AS (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS reasons FROM events GROUP BY 1) SELECT reasons, count(*) AS n FROM u GROUP BY 1",
    "stored_blobs": """WITH d AS (SELECT 'sha256:' || sha256(text) AS sha256, doc_id, CAST(length(text) AS INTEGER) AS size FROM documents)
SELECT sha256, doc_id, size FROM d WHERE sha256 NOT IN (SELECT sha256 FROM d WHERE doc_id < 50) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) = 1""",
    "estimated_costs": "SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang",
}
