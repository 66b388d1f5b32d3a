"""Queries over documents and pages: text, identity, merging, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, text as X
from ..operators import extraction, merge, retrieval, rules
from .retrieval import _CLAUSES, read


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.line_clauses(read(spark, sf, "documents"), "source")


def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("char_start").alias("starts"), F.max("char_end").alias("last_end")
    )


def verbatim_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    whole = read(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    ok = F.substring(F.col("whole"), F.col("char_start") + 1, F.length("text")) == F.col("text")
    return _lines(spark, sf).join(whole, "doc_id").groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 1).alias("verbatim")
    )


def repeated_lines_by_source(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).select("corpus", "doc_id", F.col("text").alias("line"))
    normal = lines.withColumn("norm", X.without_digits(F.col("line"))).where(F.length("norm") >= 10)
    seen = normal.groupBy("corpus", "norm").agg(F.count_distinct("doc_id").alias("n_docs"))
    return seen.where("n_docs >= 3")


def running_headers(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("Running Header "), F.col("turn").cast("string"), F.lit("\n"), F.when(F.col("turn") % 3 == 0, "A shorter note\n").otherwise(""), F.col("text"))
    turns = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(page, "\n")).alias("line"))
    return extraction.running_lines(turns, "conv_id", "turn")


def digit_strip_norm(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.without_digits(F.col("text")).cast("binary")).alias("norm"), X.collapse(F.col("text")).alias("collapsed")).select(
        "doc_id", "norm", F.md5(F.col("collapsed").cast("binary")).alias("collapsed")
    )


def content_hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select("doc_id", keys.document_id(F.col("lang"), F.col("text")).alias("document_id"), keys.content_hash(F.col("text")).alias("sha256"))


def exact_dup_docs(spark: SparkSession, sf: str) -> DataFrame:
    h = read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def first_seen_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), "doc_id", "source", "lang")
    return merge.first_seen(d, ["h"], ["doc_id"]).select("doc_id", "source", "lang")


def seen_names(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.lower("p_brand").alias("k"), "p_partkey", "p_name")
    return merge.first_seen(p, ["k"], ["p_partkey"])


def column_health(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in ("lang", "source", "n_chars")])).alias("c"))
    return d.groupBy("c.column").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("c.v").alias("kinds"), F.count_if(F.trim(F.coalesce("c.v", F.lit(""))) == "").alias("blank")
    ).withColumn("constant", F.col("kinds") == 1)


def oversized_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.groupBy("source").agg(
        F.count_if(F.length("text") > 32767).alias("oversized"), F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("longest")
    )


def lifecycle_status(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").withColumn("title", F.concat_ws(" ", F.lit("Act"), F.when(F.col("doc_id") % 7 == 0, "(Repealed)"), F.when(F.col("doc_id") % 5 == 0, "Exposure Draft")))
    status = rules.lifecycle(F.col("title"), F.col("text"), F.when(F.col("doc_id") % 11 == 0, "Not yet in force"), F.col("doc_id") % 2 == 0)
    return d.withColumn("status", status).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(rules.enforced(F.col("status"))).alias("enforced"))


def boundary_rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "benchmark")
    said = F.concat_ws(" ", "text", F.when(F.col("item_id") % 2 == 0, "must not transfer\n abroad"), F.when(F.col("item_id") % 3 == 0, "as Prescribed"), F.when(F.col("item_id") % 5 == 0, "cease to retain"))
    i = F.explode(F.array(F.lit("6.1"), F.lit("6.4"), F.lit("7.3"), F.lit("9.9"))).alias("indicator")
    return t.select("item_id", said.alias("said"), i).select("item_id", "indicator", rules.admits(F.col("indicator"), F.col("said")).alias("admitted"))


def legibility(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count_if(rules.legible(F.col("text"))).alias("legible"), F.count(F.lit(1)).alias("n"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select(
        "url", title.alias("title"), F.col("page_id").alias("ord"), F.col("url").rlike(r"\.html$").alias("is_pdf"),
        ((F.col("page_id") * 37) % 101 / 100.0).alias("score"),
        F.when(F.col("page_id") % 5 == 0, "KNOWN").when(F.col("page_id") % 3 == 0, "NEW").alias("tag"),
    )


def canonical_url_groups(spark: SparkSession, sf: str) -> DataFrame:
    return merge.harvested(_links(spark, sf).withColumn("url", F.regexp_replace("url", "/[0-9]+", "/n"))).select(
        "key", "score", "is_pdf", F.coalesce("tag", F.lit("")).alias("tag"), "title", "n_variants"
    )


def representative_url(spark: SparkSession, sf: str) -> DataFrame:
    return merge.harvested(_links(spark, sf).withColumn("url", F.regexp_replace("url", "/[0-9]+", "/n"))).select("key", "url")


def link_score_projection(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import scoring

    q = X.link_tokens(F.lit("tion the of en 2024"))
    p = _links(spark, sf)
    rel = scoring.overlap(q, X.link_tokens(F.concat_ws(" ", "title", "url")))
    like = rules.has_any(F.lower(F.concat_ws(" ", "title", "url")), rules.INSTRUMENT_MARKERS)
    return p.select("url", "ord", F.round(scoring.link_score(rel, F.col("is_pdf"), like, F.col("title").rlike(X.YEAR)), 6).alias("score"), rules.chrome(F.col("url"), F.col("title")).alias("chrome"), rules.navigation_label(F.col("title")).alias("nav"))


def page_outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    html = F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 5 == 0, F.concat(F.lit("Access Denied"), "html")).otherwise(F.col("html"))
    p = read(spark, sf, "pages").select(rules.page_outcome(html, F.contains("html", F.lit("<article>"))).alias("outcome"))
    return p.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome").isin("BLOCKED", "UNRENDERED")).alias("refused"))


def html_tag_strip(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(X.without_tags(F.col("html")).cast("binary")).alias("text_md5"))


def benchmark_ngram_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents hold six words in a row of an item, by an equi-join of word runs."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    grams = lambda w: F.when(F.size(w) >= 6, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 5, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(6)), " "))).otherwise(F.array().cast("array<string>"))
    b = read(spark, sf, "benchmark").select("item_id", words("text").alias("w")).select("item_id", F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
    d = read(spark, sf, "documents").select("doc_id", words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
    return d.join(b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))


def context_window_slice(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").withColumn("quote", F.element_at(F.split("text", " "), -1))
    return d.select("doc_id", F.md5(X.context(F.col("text"), F.col("quote"), 30).cast("binary")).alias("context"))


def score_talk_redaction(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").withColumn("note", F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, ". The score is 0.9. It applies").otherwise("")))
    return c.select("conv_id", "turn", X.strip_score_talk(F.col("note")).alias("note"))


def notes_concat(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    notes = X.joined_notes(F.when(F.col("turn") == 0, "first"), F.when(F.col("role") == "user", ""), F.concat(F.lit("by "), "role"))
    return c.select("conv_id", "turn", notes.alias("notes"))


def section_index_concat(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.array_join(parts, " ").alias("whole")).select(
        "conv_id", F.length("whole").alias("n_chars"), F.substring("whole", 1, 130).alias("heading")
    )


def segment_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seg_no"), "text")
    return extraction.with_offsets(c, "conv_id", "seg_no").select("conv_id", "seg_no", "char_start", "char_end")


def segment_locator_interval(spark: SparkSession, sf: str) -> DataFrame:
    c = extraction.with_offsets(read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seg_no"), "text"), "conv_id", "seg_no").drop("text")
    points = c.select("conv_id", F.explode(F.array("char_start", (F.col("char_start") + 7), "char_end", F.col("char_end") + 1)).alias("char_start")).distinct()
    return extraction.located(points, c, "conv_id").select("conv_id", "char_start", F.coalesce("seg_no", F.lit(-1)).alias("seg_no"))


def carry_forward_state(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = read(spark, sf, "conversations")
    asked = F.last(F.when(F.col("role") == "user", F.substring("text", 1, 20)), ignorenulls=True).over(w)
    return c.select("conv_id", "turn", F.coalesce(asked, F.lit("")).alias("asked"))


def numeral_folding(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers up to 999 written in four scripts by turns, and every fifth no number, folded back."""
    n = F.col("p_partkey") % 999 + 1
    digits = n.cast("string")
    of = lambda d: F.translate(d.cast("string"), "0123456789", "零一二三四五六七八九")
    hundreds, tens, ones = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    chinese = F.concat(
        F.when(hundreds > 0, F.concat(of(hundreds), F.lit("百"))).otherwise(""),
        F.when(tens > 0, F.concat(of(tens), F.lit("十"))).when((hundreds > 0) & (ones > 0), "零").otherwise(""),
        F.when(ones > 0, of(ones)).otherwise(""),
    )
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, digits).when(k == 1, F.translate(digits, "0123456789", "０１２３４５６７８９")).when(k == 2, F.translate(digits, "0123456789", "๐๑๒๓๔๕๖๗๘๙")).when(k == 3, chinese).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", X.numeral(raw).alias("number"))


def instrument_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    title = F.concat(F.lit("Data "), F.when(F.col("s_suppkey") % 2 == 0, "(Amendment) ").otherwise(""), F.lit("Act "), (F.col("s_suppkey") % 9 + 2010).cast("string"))
    number = F.when(F.col("s_suppkey") % 3 == 0, "2012").otherwise(F.concat(F.lit("Act "), F.col("s_suppkey").cast("string")))
    return s.select(
        "s_suppkey", F.array_join(X.candidate_keys(number, title), ",").alias("keys"),
        X.section_of(F.when(F.col("s_suppkey") % 4 == 0, "Schedule 1 > Section 9").otherwise(F.concat(F.lit("S. "), F.col("s_suppkey").cast("string"), F.lit("A(1)")))).alias("section"),
        F.array_join(X.amendment_queries(title), "|").alias("queries"), X.act_number(F.concat_ws(" ", title, F.lit("Act 709"))).alias("act"),
    )


def submission_projection(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.sinks import submission

    d = read(spark, sf, "documents").select(
        F.upper("lang").alias("economy"), F.col("source").alias("law_name"), F.lit("").alias("law_number"), F.lit("").alias("last_amended"), F.lit("P6-I1").alias("indicator_id"),
        F.concat(F.lit("Section "), F.col("doc_id").cast("string")).alias("article"), F.when(F.col("doc_id") % 2 == 0, "NEW").alias("discovery_tag"), F.lit("p. 1").alias("location"),
        F.substring("text", 1, 50).alias("quote"), F.lit("states it").alias("rationale"), F.lit("http://x").alias("source_url"), F.lit(0.5).alias("confidence"), F.lit("").alias("notes"),
    )
    return submission(d)


_L = f"WITH {_CLAUSES}"
_HARVEST = r"""WITH a AS (SELECT regexp_replace(url, '/[0-9]+', '/n', 'g') AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id AS ord,
  (page_id * 37) % 101 / CAST(100 AS DOUBLE) AS score, page_id % 5 = 0 AS known, page_id % 3 = 0 AND page_id % 5 <> 0 AS new FROM pages),
k AS (SELECT *, regexp_matches(url, '\.html$') AS is_pdf, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')) AS key FROM a)"""
_WORDS6 = "regexp_extract_all(lower(text), '[a-z]+')"

_ALL = (
    line_offsets, verbatim_roundtrip, repeated_lines_by_source, running_headers, digit_strip_norm, content_hash_ids, exact_dup_docs,
    first_seen_docs, seen_names, column_health, oversized_cells, lifecycle_status, boundary_rule_filter, legibility,
    canonical_url_groups, representative_url, link_score_projection, page_outcome_tally, html_tag_strip, benchmark_ngram_copy,
    context_window_slice, score_talk_redaction, notes_concat, section_index_concat, segment_offsets, segment_locator_interval,
    carry_forward_state, numeral_folding, instrument_keys, submission_projection,
)
QUERIES = {f.__name__: f for f in _ALL}


def _any(column: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in markers) + ")"


_SAID = "lower(trim(regexp_replace(said, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"
ORACLE_SQL = {
    "line_offsets": f"{_L} SELECT doc_id, count(*) AS n, CAST(sum(char_start) AS BIGINT) AS starts, CAST(max(char_end) AS INTEGER) AS last_end FROM c GROUP BY doc_id",
    "verbatim_roundtrip": f"{_L} SELECT corpus, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) FILTER (substring(whole, CAST(char_start AS BIGINT) + 1, length(text)) = text) / count(*), 1) AS verbatim FROM c GROUP BY corpus",
    "repeated_lines_by_source": f"""{_L} SELECT corpus, norm, count(DISTINCT doc_id) AS n_docs FROM (SELECT corpus, doc_id, lower(trim(regexp_replace(text, '[0-9]+', '', 'g'))) AS norm FROM c)
WHERE length(norm) >= 10 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""",
    "running_headers": """WITH l AS (SELECT conv_id, turn, unnest(string_split('Running Header ' || turn || chr(10) || CASE WHEN turn % 3 = 0 THEN 'A shorter note' || chr(10) ELSE '' END || text, chr(10))) AS line FROM conversations), p AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM l GROUP BY 1),
n AS (SELECT conv_id, lower(trim(regexp_replace(line, '[0-9]+', '', 'g'))) AS norm, count(DISTINCT turn) AS n_pages FROM l GROUP BY 1, 2)
SELECT conv_id, norm, n_pages FROM n JOIN p USING (conv_id) WHERE length(norm) >= 10 AND pages >= 4 AND n_pages >= greatest(3, floor(0.4 * pages))""",
    "digit_strip_norm": r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[0-9]+', '', 'g')))) AS norm, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS collapsed FROM documents",
    "content_hash_ids": "SELECT doc_id, lower(lang) || ':' || substring(sha256(text), 1, 16) AS document_id, 'sha256:' || sha256(text) AS sha256 FROM documents",
    "exact_dup_docs": "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "first_seen_docs": "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1",
    "seen_names": "SELECT lower(p_brand) AS k, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) = 1",
    "column_health": """WITH c AS (SELECT 'lang' AS column, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents)
SELECT "column", count(*) AS n, count(DISTINCT v) AS kinds, count(*) FILTER (trim(coalesce(v, '')) = '') AS blank, count(DISTINCT v) = 1 AS constant FROM c GROUP BY 1""",
    "oversized_cells": "SELECT source, count(*) FILTER (length(text) > 32767) AS oversized, (list(doc_id ORDER BY length(text) DESC, doc_id))[1] AS longest FROM documents GROUP BY source",
    "lifecycle_status": r"""WITH d AS (SELECT doc_id, 'Act' || CASE WHEN doc_id % 7 = 0 THEN ' (Repealed)' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' Exposure Draft' ELSE '' END AS title, substring(text, 1, 1500) AS head FROM documents),
s AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'DRAFT' WHEN doc_id % 2 = 0 THEN 'IN_FORCE' WHEN regexp_matches(title, '(?i)\(\s*(?:repealed|spent|ceased|revoked)\b') THEN 'REPEALED'
  WHEN regexp_matches(title, '(?i)\bexposure draft\b') THEN 'DRAFT' WHEN regexp_matches(head, '(?i)\bthis\s+(?:act|regulation|ordinance|decree|law)\s+(?:is|has been|was)\s+repealed\b') THEN 'REPEALED'
  WHEN regexp_matches(head, '(?i)\bexposure draft\b|\[\s*draft[^\]]*\]|\bfor public consultation\b') THEN 'DRAFT' ELSE 'UNKNOWN' END AS status FROM d)
SELECT status, count(*) AS n, count(*) FILTER (status NOT IN ('REPEALED', 'DRAFT')) AS enforced FROM s GROUP BY status""",
    "boundary_rule_filter": f"""WITH t AS (SELECT item_id, concat_ws(' ', text, CASE WHEN item_id % 2 = 0 THEN 'must not transfer' || chr(10) || ' abroad' END, CASE WHEN item_id % 3 = 0 THEN 'as Prescribed' END, CASE WHEN item_id % 5 = 0 THEN 'cease to retain' END) AS said FROM benchmark),
n AS (SELECT item_id, unnest(['6.1', '6.4', '7.3', '9.9']) AS indicator, {_SAID} AS s FROM t)
SELECT item_id, indicator, CASE indicator WHEN '7.3' THEN NOT {_any('s', rules.RETENTION_LIMIT)} OR {_any('s', rules.RETENTION_MINIMUM)}
  WHEN '6.1' THEN NOT regexp_matches(s, '{rules.CROSS_BORDER}') OR NOT {_any('s', rules.TRANSFER_CONDITION)}
  WHEN '6.4' THEN NOT regexp_matches(s, '{rules.CROSS_BORDER}') OR NOT {_any('s', rules.TRANSFER_BAN)} OR {_any('s', rules.TRANSFER_CONDITION)} ELSE true END AS admitted FROM n""",
    "legibility": f"""WITH w AS (SELECT lang, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS ws FROM documents)
SELECT lang, count(*) FILTER (len(ws) >= 120 AND len(list_filter(ws, lambda x: x IN ({', '.join(repr(w) for w in rules.FUNCTION_WORDS)}))) >= CAST(0.1 AS DOUBLE) * len(ws)) AS legible, count(*) AS n FROM w GROUP BY lang""",
    "canonical_url_groups": f"""{_HARVEST} SELECT key, max(score) AS score, bool_or(is_pdf) AS is_pdf, CASE WHEN bool_or(known) THEN 'KNOWN' WHEN bool_or(new) THEN 'NEW' ELSE '' END AS tag,
(list(title ORDER BY length(title) DESC, ord))[1] AS title, count(DISTINCT url) AS n_variants FROM k GROUP BY key""",
    "representative_url": f"""{_HARVEST} SELECT key, (list(url ORDER BY CASE WHEN regexp_matches(url, '(?i)(provids|pr[0-9]+-|#pr)') THEN 1 ELSE 0 END, length(regexp_replace(url, '[^?#&]', '', 'g')), length(url), url))[1] AS url FROM k GROUP BY key""",
    "link_score_projection": rf"""WITH p AS (SELECT url, page_id AS ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
t AS (SELECT *, lower(title || ' ' || url) AS tu, lower(url || ' ' || title) AS ut FROM p),
r AS (SELECT *, len(list_intersect(list_distinct(['tion', 'the', 'of', 'en', '2024']), list_distinct(regexp_extract_all(tu, '[a-z0-9]+')))) / CAST(5 AS DOUBLE) AS rel FROM t)
SELECT url, ord, round(least(1, CAST(0.75 AS DOUBLE) * rel + CASE WHEN regexp_matches(url, '\.html$') THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN {_any('tu', rules.INSTRUMENT_MARKERS)} THEN CAST(0.1 AS DOUBLE) ELSE 0 END
  + CASE WHEN regexp_matches(title, '\b(1[6-9]\d{{2}}|20\d{{2}})\b') THEN CAST(0.05 AS DOUBLE) ELSE 0 END), 6) AS score, {_any('ut', rules.CHROME)} AS chrome,
  regexp_replace(lower(trim(regexp_replace(title, '[ \t\n\x0B\f\r]+', ' ', 'g'))), '\.+$', '') IN ({', '.join(repr(w.rstrip('.')) for w in rules.NAVIGATION)}) AS nav FROM r""",
    "page_outcome_tally": r"""WITH h AS (SELECT CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 5 = 0 THEN 'Access Denied' || html ELSE html END AS x, contains(html, '<article>') AS has FROM pages),
o AS (SELECT CASE WHEN trim(x) = '' THEN 'UNRENDERED' WHEN regexp_matches(lower(substring(x, 1, 4096)), 'access denied|request unsuccessful|captcha|are you a robot|error 403|403 forbidden') THEN 'BLOCKED' WHEN has THEN 'RESULTS'
  WHEN regexp_matches(lower(substring(x, 1, 4096)), '<body[^>]*>\s*</body>') THEN 'UNRENDERED' ELSE 'EMPTY' END AS outcome FROM h)
SELECT outcome, count(*) AS n, count(*) FILTER (outcome IN ('BLOCKED', 'UNRENDERED')) AS refused FROM o GROUP BY outcome""",
    "html_tag_strip": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM pages",
    "benchmark_ngram_copy": f"""WITH u AS (SELECT 'b' AS k, item_id AS id, unnest({_WORDS6}) AS w, generate_subscripts({_WORDS6}, 1) AS i FROM benchmark
  UNION ALL SELECT 'd', doc_id, unnest({_WORDS6}), generate_subscripts({_WORDS6}, 1) FROM documents),
g AS (SELECT k, id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o AS g FROM u WINDOW o AS (PARTITION BY k, id ORDER BY i))
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM (SELECT DISTINCT * FROM g WHERE k = 'd' AND g IS NOT NULL) AS d JOIN (SELECT DISTINCT * FROM g WHERE k = 'b' AND g IS NOT NULL) AS b USING (g) GROUP BY ALL""",
    "context_window_slice": """WITH q AS (SELECT doc_id, text, string_split(text, ' ')[-1] AS quote FROM documents), p AS (SELECT *, strpos(text, quote) AS p FROM q)
SELECT doc_id, md5(CASE WHEN length(quote) > 0 THEN substring(text, greatest(p - 30, 1), p - greatest(p - 30, 1) + length(quote) + 30) ELSE '' END) AS context FROM p""",
    "score_talk_redaction": r"""WITH c AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN '. The score is 0.9. It applies' ELSE '' END AS note FROM conversations)
SELECT conv_id, turn, trim(array_to_string(list_filter(regexp_extract_all(note, '[^.!?]+[.!?]?'), lambda s: NOT regexp_matches(s, '(?i)\bscor(?:e|es|ed|ing)\b')), '')) AS note FROM c""",
    "notes_concat": "SELECT conv_id, turn, concat_ws(' | ', CASE WHEN turn = 0 THEN 'first' END, 'by ' || role) AS notes FROM conversations",
    "section_index_concat": "WITH w AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole FROM conversations GROUP BY 1) SELECT conv_id, CAST(length(whole) AS INTEGER) AS n_chars, substring(whole, 1, 130) AS heading FROM w",
    "segment_offsets": """WITH s AS (SELECT conv_id, turn AS seg_no, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM conversations)
SELECT conv_id, seg_no, CAST(st AS INTEGER) AS char_start, CAST(st + n AS INTEGER) AS char_end FROM s""",
    "segment_locator_interval": """WITH s AS (SELECT conv_id, turn AS seg_no, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM conversations),
z AS (SELECT conv_id, seg_no, a, a + n AS b, a = max(a) OVER (PARTITION BY conv_id) AS last FROM s),
p AS (SELECT DISTINCT conv_id, unnest([a, a + 7, b, b + 1]) AS x FROM z)
SELECT conv_id, CAST(x AS INTEGER) AS char_start, coalesce((SELECT max(seg_no) FROM z WHERE z.conv_id = p.conv_id AND x >= a AND (x < b OR (x = b AND last))), -1) AS seg_no FROM p""",
    "carry_forward_state": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN substring(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS asked FROM conversations",
    "numeral_folding": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE CAST(p_partkey % 999 + 1 AS VARCHAR) END AS number FROM part",
    "instrument_keys": """SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 3 <> 0 THEN 'act:' || s_suppkey END, 'title:data act ' || (s_suppkey % 9 + 2010)) AS keys,
CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_suppkey || 'A' END AS section, 'Data (Amendment) Act|Data Amendment' AS queries, 'Act 709' AS act FROM supplier""",
    "submission_projection": """SELECT upper(lang) AS "Economy", source AS "Law Name", '' AS "Law Number / Ref", '' AS "Last Amended", 'P6-I1' AS "Indicator ID", 'Section ' || doc_id AS "Article / Section",
CASE WHEN doc_id % 2 = 0 THEN 'NEW' ELSE 'KNOWN' END AS "Discovery Tag", 'p. 1' AS "Location Reference", substring(text, 1, 50) AS "Verbatim Snippet", 'states it' AS "Mapping Rationale", 'http://x' AS "Source URL", CAST(0.5 AS DOUBLE) AS "Confidence", '' AS "Notes" FROM documents""",
}
