"""Queries of single steps: gates, names, discovery, acquisition. Each reads whole tables; its SQL stands below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, scoring, text as X
from ..operators import currency, discovery, evaluation, extraction, portals, reports, rules, telemetry
from ..sources import catalogue, files, pages, sinks, trackers
from .lanes import _amending
from .retrieval import read

_S = F.lit


def _cat(*parts):
    return F.concat(*[_S(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


# --- gates and filters


def year_gate(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    floor = F.when(F.col("o_orderkey") % 3 != 0, 1990 + F.col("o_orderkey") % 10)
    return o.where(rules.after_floor(F.year("o_orderdate"), floor)).select("o_orderkey")


def contents_overrule_titles(spark: SparkSession, sf: str) -> DataFrame:
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    contents = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(_S("a")))
    return p.select("p_partkey", rules.coalesced_verdict(contents, F.when(k % 2 == 0, F.array(_S("x"))).otherwise(none)).alias("kept"))


def working_set(spark: SparkSession, sf: str) -> DataFrame:
    """A narrowing that something meets, and one that nothing does."""
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    some = rules.or_whole(p, F.contains(F.lower("p_name"), _S("ring"))).withColumn("asked", _S("ring"))
    return some.unionByName(rules.or_whole(p, F.contains(F.lower("p_name"), _S("qqq"))).withColumn("asked", _S("qqq"))).select("asked", "p_partkey")


def web_links(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages")
    url = F.when(F.col("page_id") % 4 == 0, F.replace("url", _S("http"), _S("ftp"))).when(F.col("page_id") % 4 == 1, _cat(" ", F.upper("url"))).otherwise(F.col("url"))
    return p.where(rules.web_address(keys.normal_url(url))).select("page_id")


def answered_fetches(spark: SparkSession, sf: str) -> DataFrame:
    d, k = read(spark, sf, "documents"), F.col("doc_id")
    status = F.when(k % 5 == 0, 404).when(k % 7 == 0, 204).when(k % 11 != 0, 200)
    return d.where(rules.answered(status, F.when(k % 3 != 0, F.col("text")).otherwise(""))).select("doc_id")


_AGREED = ("Free Trade Agreement", "Data Act", "Partnership of the Sea", "CPTPP", "Order in Council")


def binding_instruments(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[_S(n) for n in _AGREED])
    s = read(spark, sf, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % len(_AGREED)).cast("int")).alias("name"))
    return s.where(~rules.trade_agreement(F.col("name"))).select("s_suppkey", "name")


def horizontal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda c, x: F.when(c, F.array(_S(x))).otherwise(F.array().cast("array<string>"))
    p = read(spark, sf, "part").select("p_partkey", F.concat(one(k % 2 == 0, "P7-I3"), one(k % 3 == 0, "P7-I5"), one(k % 5 == 0, "P6-I1")).alias("hits"))
    return p.where(rules.horizontal_only(F.col("hits"))).select("p_partkey")


_NAMED = ("the Data Act 2001", "GDPR of the EU", "act", "The  Data Act 2001", "via Privacy Ordinance", "short", "British Data Law")


def tidied_names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[_S(n) for n in _NAMED])
    c = read(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("ord"), F.get(names, (F.col("c_custkey") % len(_NAMED)).cast("int")).alias("name"))
    return rules.tidy_names(c, ["c_nationkey"]).select("c_nationkey", "name", "ord")


def provision_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of customers by nation, with an answer for those that have none."""
    rows = read(spark, sf, "customer").where("c_custkey % 3 = 0").groupBy(F.upper("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation")).agg(F.min("c_name").alias("quote"))
    scope = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), F.explode(F.array(_S("building"), _S("none"))).alias("segment"))
    return reports.lookup(rows, scope, ["segment", "nation"], "quote").select("segment", "nation", "quote")


def page_bands(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where(F.trim("line") != "")
    return extraction.band(lines, ["doc_id"], "ord").groupBy("doc_id").agg(F.count_if("in_band").alias("edge"), F.count(F.lit(1)).alias("n"))


def _furnished(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, turns as pages, with running lines, page numbers, navigation and an imprint."""
    turn = F.col("turn")
    head = F.concat(_S("Laws of the Realm "), turn.cast("string"), _S("\n"), (turn + 1).cast("string"), _S("\n"))
    nav = F.when(turn % 2 == 0, "Section 12A\nPart 3  Offences\n").otherwise("")
    tail = F.when(turn >= 4, "\nPrinted by the Government Printer\nPrice 3.00").otherwise("\nnote")
    body = F.when(turn >= 5, _S("x")).otherwise(F.col("text"))
    text = F.when(turn == 3, "").otherwise(F.concat(head, nav, body, tail))
    return read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), turn.cast("int").alias("page_number"), text.alias("text"))


def running_lines_gone(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stay on each page, and a sum of where they stood, once running lines and their companions have gone."""
    kept = pages.without_running(pages.lines_of(_furnished(spark, sf))).where("not gone")
    return kept.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("places"))


def navigation_headers(spark: SparkSession, sf: str) -> DataFrame:
    lines = pages.lines_of(_furnished(spark, sf))
    return lines.where(pages.navigation_header(F.col("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def tails_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without their imprints: the length of each, and the text's, joined."""
    out = extraction.with_offsets(pages.without_tail(_furnished(spark, sf)), "document_id", "page_number")
    return out.select("document_id", "page_number", F.length("text").alias("n"), "char_end")


def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.cleaned(_furnished(spark, sf)).select("document_id", "page_number", "text", "char_start", "char_end")


def page_confidence(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("text"), ((F.col("turn") * 7 + F.col("conv_id")) % 10 / 10.0).alias("ocr_confidence")
    )
    return pages.mean_confidence(c).select("document_id", F.coalesce("ocr_confidence", F.lit(-1.0)).alias("ocr_confidence"))


def reassembled_segments(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seg_no"), "text")
    return extraction.reassembled(c, "conv_id", "seg_no").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"))


# --- names, texts and prompts


_SHELLS = (" Current version as at 1 May 2020 x", " (REPEALED) 1999", " Reprint 4", "", " Act")


def name_slots(spark: SparkSession, sf: str) -> DataFrame:
    shell = F.get(F.array(*[_S(x) for x in _SHELLS]), (F.col("s_suppkey") % len(_SHELLS)).cast("int"))
    title = F.concat(_S(" Law  of "), F.col("s_name"), shell)
    return read(spark, sf, "supplier").select("s_suppkey", X.name_slot(title).alias("slot"), X.law_name(title).alias("name"), X.is_file_name(F.concat(F.col("s_name"), _S(".pdf"))).alias("is_file"))


def search_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", X.rendered_search(_S("https://h/s?q={query}&p=1"), F.concat("p_name", _S(" & é"))).alias("address"))


def title_years(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = _cat("Act ", 1990 + k % 30, " and ", 2000 + k % 3), F.when(k % 5 == 0, "Order").otherwise(_cat("Order ", 1990 + k % 7))
    return read(spark, sf, "part").select("p_partkey", F.array_join(X.years(a).cast("array<string>"), ",").alias("years"), X.years_conflict(a, b).alias("conflict"))


def year_agreement(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    number, title = F.when(k % 4 == 0, "").otherwise(_cat("Act 7 of ", 1990 + k % 9)), F.when(k % 5 == 0, "Data Act").otherwise(_cat("Data Act ", 1990 + k % 6))
    return read(spark, sf, "orders").select("o_orderkey", X.year_agrees(number, title).alias("agrees"))


def copy_guard(spark: SparkSession, sf: str) -> DataFrame:
    words = F.slice(F.split("text", " "), 1, 8)
    return read(spark, sf, "documents").select("doc_id", X.copies(words, F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 60)).otherwise("none of it")).alias("copied"))


def rationales(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(_cat("Section ", "$p_partkey"))
    phrases = F.array(_S("ring"), _S(""), _S("RED"), _S("bolt"))
    return read(spark, sf, "part").select("p_partkey", X.template_rationale(path, _S("P6-I1"), _S("Bans"), phrases, F.col("p_name"), 75).alias("rationale"))


def printed_number_check(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("doc_id") % 3 == 0, "none").otherwise(_cat("n. ", F.col("doc_id") % 100))
    return read(spark, sf, "documents").select("doc_id", X.printed_numbers(value, F.col("text")).alias("printed"))


def lenient_answers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn").cast("string")
    k = (F.col("conv_id") + F.col("turn")) % 5
    said = (
        F.when(k == 0, F.concat(_S('{"a": '), t, _S("}"))).when(k == 1, F.concat(_S('so:\n```json\n{"a": '), t, _S("}\n``` done")))
        .when(k == 2, F.concat(_S('it is {"a": '), t, _S("} I think"))).when(k == 3, "no object here").otherwise('[1, 2]')
    )
    return read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.get_json_object(X.lenient_object(said), "$.a"), _S("")).alias("a"))


def clause_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompt = X.clause_prompt(_S("I1: bans"), _cat("Section ", "$item_id"), F.col("text"), 40)
    return read(spark, sf, "benchmark").select("item_id", prompt.alias("prompt"), X.fingerprint(_S("judge"), prompt).alias("fingerprint"))


_TITLES = ("Advisory Guidelines 12 May 2020 On Data", "3 June 2019   Guide to é", "Tools 1 Jan 2001 ", "Plain Title", "Practical Guidance on 5 May 2020 x")


def guidance_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.get(F.array(*[_S(x) for x in _TITLES]), (F.col("s_suppkey") % len(_TITLES)).cast("int"))
    return read(spark, sf, "supplier").select("s_suppkey", X.guidance_title(title).alias("title"), X.printable(title).alias("shown"))


_LAWS = [("PDPA", ("act709", "acta1727"), ("personal data",), ("code of practice",)), ("CMA", ("act588",), (), ()), ("CRIMINAL", (), ("penal", "code"), ())]
_LAW_NAMES = ("Act 709", "Personal Data Protection Act 2010", "Personal Data Code of Practice", "Communications Act 588", "The Penal Code", "Order A1727", "Act 1998", "Other Law")


def law_classes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.get(F.array(*[_S(x) for x in _LAW_NAMES]), (F.col("s_suppkey") % len(_LAW_NAMES)).cast("int"))
    return read(spark, sf, "supplier").select("s_suppkey", F.coalesce(X.classified(name, _LAWS), _S("")).alias("law"), X.act_core(name).alias("core"))


def synonym_terms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 4 == 0, _S("none")).otherwise(F.concat(_S('Sure: {"terms": [" Ring ", "ring", "", "'), F.repeat(_S("x"), 81), _S('", "t'), k, _S('", "a  b"]}')))
    return read(spark, sf, "part").select("p_partkey", F.array_join(X.synonyms(said), "|").alias("terms"))


def portal_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem")
    relevance, principal, live = F.col("l_discount") * 5, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return x.select(
        "l_orderkey", "l_linenumber", F.round(scoring.register_score(relevance, principal, live), 6).alias("register"), F.round(scoring.search_score(relevance, F.col("l_tax"), principal), 6).alias("search")
    )


def retrieval_methods(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    method = reports.retrieval_method(k % 2 == 0, F.when(k % 3 == 0, "per_clause").otherwise(""), F.when(k % 5 == 0, "CONFLICT_REVIEW").otherwise("VERIFIED"))
    return read(spark, sf, "part").groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"))


def review_expectations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, "LIKELY-OK").when(k % 3 == 1, "LIKELY-WRONG").otherwise("UNSURE")
    sheet = F.when(k % 4 == 0, "round_my").when(k % 4 == 1, "x_sg_2").otherwise("other")
    return read(spark, sf, "supplier").select(
        "s_suppkey", reports.expected_verdict(said).alias("expected"), reports.pillar_of(F.when(k % 2 == 0, _cat("P", k % 12, "-I2")).otherwise("P7")).alias("pillar"), reports.sheet_iso(sheet).alias("iso")
    )


def statute_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Statutes as prompts: openings of sections, and whole."""
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat(F.col("text"), _S(" \n x")).alias("text"), _cat("s", F.floor(F.col("turn") / 2)).alias("section"))
    short, whole = reports.section_blocks(c, ["conv_id"], most=30), reports.section_blocks(c, ["conv_id"], most=None).withColumnRenamed("block", "whole")
    return short.join(whole, "conv_id").select("conv_id", F.col("block"), F.md5(F.col("whole").cast("binary")).alias("whole"))


def section_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    told = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 60).alias("iso"), F.col("l_linenumber").cast("string").alias("section"), F.col("l_returnflag").alias("indicator")).distinct()
    statute = read(spark, sf, "customer").select((F.col("c_custkey") % 70).alias("iso"), (F.col("c_custkey") % 11).cast("string").alias("section"))
    blocks = reports.suggestions(told, statute, ["iso"]).groupBy("iso", "indicator").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return blocks.select("iso", "indicator", reports.answer_block(F.col("indicator"), _cat("law ", "$iso"), F.col("n")).alias("block"))


def documents_by_content(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("lang").alias("iso"), F.col("doc_id").cast("string").alias("document_id"), F.substring("text", 1, 400).alias("head"), F.length("text").alias("n_pages"))
    needles = d.select("iso").distinct().select("iso", F.explode(F.array(F.array(_S("TION"), _S(" the ")), F.array(_S("de")), F.array(_S("zzzz")))).alias("needles"))
    return reports.document_by_content(d, needles).select("iso", F.array_join("needles", ",").alias("needles"), "document_id")


# --- discovery and portals


def query_floor_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(_cat("$c_mktsegment", "$c_nationkey").alias("q"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_custkey") % 50).alias("floor"))
    return discovery.query_floors(c, "q", "floor").select("q", F.coalesce("floor", F.lit(-1).cast("long")).alias("floor"))


def inventory_backstop(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    stock = p.select(F.col("p_partkey").alias("act_no"), F.when(F.col("p_partkey") % 3 != 0, "x.pdf").alias("pdf"))
    found = read(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("act_no"))
    return discovery.backstop(p.where("p_size < 10").select(F.col("p_partkey").alias("act_no")), stock, found).select("act_no", "score", "tag")


def identity_by_number(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).cast("int").alias("no"), F.when(F.col("s_suppkey") % 2 == 0, "NEW").alias("tag"), F.lit(None).cast("string").alias("matched"))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("no"), F.col("n_name").alias("name"))
    return discovery.identified(c, n, "no").select("s_suppkey", F.coalesce("tag", _S("")).alias("tag"), F.coalesce("matched", _S("")).alias("matched"))


def fulltext_priority(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    url = discovery.resolved_fulltext(F.when(k % 4 == 0, "e"), F.col("url"), k % 3 == 0, F.when(k % 5 == 0, "r"), _S("p"))
    return read(spark, sf, "pages").select("page_id", url.alias("fulltext"))


def grouped_search_records(spark: SparkSession, sf: str) -> DataFrame:
    each = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("act_id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("principal"), F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p")
    )
    x = each.select(
        (F.col("l_orderkey") % 100).alias("query"), "act_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.lit(1000000).alias("span"), "principal",
        _cat("T", "$s").alias("title"), F.when(F.col("l_linenumber") % 2 == 0, _cat("f", "$p")).alias("fulltext"), _cat("u", "$l_orderkey", "-", "$l_linenumber").alias("url"),
    )
    return portals.grouped_records(x).select("query", "act_id", F.round("relevance", 6).alias("relevance"), "principal", "title", F.coalesce("fulltext", _S("")).alias("fulltext"), "url", "n_records")


def child_regulation_links(spark: SparkSession, sf: str) -> DataFrame:
    acts = read(spark, sf, "nation").select(F.col("n_nationkey").alias("act_id"), F.col("n_name").alias("stem"))
    c = read(spark, sf, "customer")
    titles = c.select(F.col("c_custkey").alias("title_id"), _cat("Rules of nation_", F.col("c_custkey") % 25).alias("name"))
    return portals.child_regulations(acts, titles, c.select(F.col("c_custkey").alias("title_id"), F.col("c_nationkey").alias("act_id")), 5).select("act_id", "title_id", "name", "place")


def strategy_fallback(spark: SparkSession, sf: str) -> DataFrame:
    special = read(spark, sf, "customer").where("c_custkey % 60 = 1").select(F.col("c_nationkey").alias("portal"), F.col("c_name").alias("item"))
    generic = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("portal"), F.col("s_name").alias("item"))
    return portals.specialised_else_generic(special, generic, "portal")


def retry_list(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "BLOCKED").when(F.col("event_type") == "click", "UNRENDERED").otherwise("RESULTS")
    e = read(spark, sf, "events").select((F.col("user_id") % 5).alias("portal"), F.col("user_id").alias("query"), outcome.alias("outcome"), F.col("event_id").alias("ord"))
    return portals.retry_queue(e)


def guidance_documents(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").select(F.regexp_replace("url", r"[0-9]+([?#].*)?$", "").alias("href"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("anchor_text"), F.col("page_id").alias("ord"))
    return portals.guidance(p, F.contains(F.lower("anchor_text"), _S("the"))).select("href", "title")


def strategies_by_host(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.sql("SELECT * FROM VALUES ('Example.COM', 1, 'search'), ('thth', 0, 'concept'), ('.net', 2, 'connector') AS t(needle, ord, strategy)")
    hosts = read(spark, sf, "pages").select(keys.host(F.col("url")).alias("host")).distinct()
    return portals.strategy_for(hosts, known).select("host", F.coalesce("strategy", _S("")).alias("strategy"))


def act_inventory(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    feeds = p.select(
        (F.col("p_partkey") % 150).alias("act_no"), F.col("p_partkey").alias("feed_ord"), F.col("p_name").alias("title"), (F.col("p_size") > 25).alias("malay"),
        F.when(F.col("p_partkey") % 4 == 0, "2001").when(F.col("p_partkey") % 4 == 1, " ").alias("commencement"), F.when(F.col("p_partkey") % 3 == 0, _cat("x", "$p_partkey")).alias("pdf"),
    )
    repeals = read(spark, sf, "supplier").select((F.col("s_suppkey") * 7 % 170).alias("act_no"), F.col("s_suppkey")).groupBy("act_no").agg(F.max("s_suppkey").cast("string").alias("repealed_by"))
    out = discovery.inventory(feeds, repeals)
    blank = lambda c: F.coalesce(c, _S("")).alias(c)
    return out.select("act_no", blank("title"), blank("commencement"), blank("pdf"), F.coalesce(F.size("feeds"), F.lit(0)).alias("feeds"), blank("repealed_by"), "repealed", F.coalesce("in_force", F.lit(False)).alias("in_force"))


_HINTS = "SELECT * FROM VALUES ('P6-I1', 'ring'), ('P6-I2', 'widget'), ('P7-I1', 'blue bolt'), ('P7-I1', 'ring') AS t(indicator, phrase)"


def hint_attribution(spark: SparkSession, sf: str) -> DataFrame:
    hits = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return discovery.attributed(hits, spark.sql(_HINTS)).select("id", F.array_join("indicators", ",").alias("indicators"))


def discovered_instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as links of searches, by name and budget: what a discovery gives."""
    p = read(spark, sf, "pages")
    title = F.when(F.col("page_id") % 10 == 0, "Data Protection Act 2010").otherwise(_cat("Zq ", F.col("page_id") % 50, " xv"))
    links = p.select(
        (F.col("page_id") % 4).alias("query"), F.regexp_replace("url", "/[0-9]+", "/n").alias("url"), title.alias("title"), (F.col("page_id") * 37 % 101 / 100.0).alias("score"),
        F.lit(False).alias("is_pdf"), F.col("page_id").alias("ord"),
    )
    known = spark.sql("SELECT 0 AS ord, 'Data Protection Act 2010' AS name")
    phrases = spark.sql("SELECT * FROM VALUES (0L, 'I1'), (1L, 'I2'), (1L, 'I1'), (2L, 'I3') AS t(query, indicator)")
    out = discovery.discovered(links, known, phrases, 10)
    return out.select("key", F.round("score", 6).alias("score"), F.coalesce("tag", _S("")).alias("tag"), "title", F.array_join("indicators", ",").alias("indicators"), "n_variants")


def follow_on_passes(spark: SparkSession, sf: str) -> DataFrame:
    row = lambda t, k, key, query: read(spark, sf, t).select(_cat("a", key).alias("key"), _cat(f"{t} ", f"${k}").alias("title"), (1990 + F.col(k) % 30).cast("int").alias("year"), query.alias("query"))
    main = row("supplier", "s_suppkey", F.col("s_suppkey") % 80, F.col("s_suppkey") % 3)
    amending = row("customer", "c_custkey", F.col("c_custkey") % 500, F.col("c_custkey") % 3)
    children = row("part", "p_partkey", F.col("p_partkey") % 700, F.col("p_partkey") % 3)
    floors = spark.sql("SELECT * FROM VALUES (0L, 2000), (1L, CAST(NULL AS INT)) AS t(query, floor)")
    return discovery.follow_on(main, [("amendments", amending), ("children", children)], floors)


def register_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    title = p.where("p_partkey % 10 <> 0").select(k.alias("act_no"), F.lit(1).alias("stage"), F.when(k % 3 == 0, F.array(_S("P7-I3"))).when(k % 3 == 1, F.array(_S("P6-I1"), _S("P7-I3"))).otherwise(none).alias("hits"))
    contents = p.where("p_partkey % 4 = 0").select(k.alias("act_no"), F.lit(2).alias("stage"), F.when(k % 8 == 0, F.array(_S("P7-I5"))).otherwise(none).alias("hits"))
    out = discovery.enumerated(p.select(k.alias("act_no"), F.col("p_name").alias("title")), title.unionByName(contents), rules.FRAMEWORK)
    return out.select("act_no", F.array_join("indicators", ",").alias("indicators"), "stage", "keep")


def tracker_codes(spark: SparkSession, sf: str) -> DataFrame:
    script = F.concat(_S('var x=1; countries = {"n'), F.col("s_suppkey").cast("string"), _S('": ['), (F.col("s_suppkey") % 3).cast("string"), _S(", "), (F.col("s_suppkey") % 4).cast("string"), _S("]};"))
    s = read(spark, sf, "supplier").select(script.alias("text"))
    return trackers.code_map(s, {0: ("P6-I1", "P6-I2"), 1: ("P7-I1",), 2: ("P7-I2",)}, {1: "yes", 2: "no"}, "tracker").select("economy", "indicator", "presence", "note")


def tracker_prose(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("block_no"), "text")
    return files.prose(c, "page", r"(?i)\b(the|de|of)\b", 20, 2, 100)


def tracker_seeds(spark: SparkSession, sf: str) -> DataFrame:
    said = read(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("economy"), F.when(F.col("c_custkey") % 3 == 0, "yes").otherwise("no").alias("presence"),
        F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).when(F.col("c_custkey") % 5 == 0, "").otherwise(F.initcap("c_mktsegment")).alias("law"),
    )
    return trackers.seeds(said)


def statute_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of statutes, or why there are none."""
    k = F.col("doc_id")
    url, status = F.when(k % 11 != 0, "http://x"), F.when(k % 7 == 0, 404).otherwise(200)
    text = F.concat(F.substring("text", 1, 500), F.when(k % 2 == 0, " Arrangement of Sections ").otherwise(""), F.substring("text", 501, 300))
    found = files.contents(url, status, F.lit(1000), F.when(k % 5 == 0, "<htm").otherwise("%PDF"), text, k % 3 == 0)
    return read(spark, sf, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.reason", F.md5(F.col("f.text").cast("binary")).alias("text"))


def book_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(files.inner_body(F.col("html").cast("binary")).cast("binary")).alias("body"))


def shared_phrases(spark: SparkSession, sf: str) -> DataFrame:
    k = read(spark, sf, "part").select(F.col("p_brand").alias("iso"), F.col("p_name").alias("phrase"), F.col("p_type").alias("indicator"))
    return catalogue.phrase_map(k).select("iso", "phrase", F.array_join("indicators", ",").alias("indicators"))


def upserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    held = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    new = read(spark, sf, "orders").where("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("v"))
    return catalogue.upserted(held, new)


# --- sinks


def jsonld_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.jsonld_lines(read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "http://x/v#")


def artifact_labels(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(_S("DEMO_"), F.col("s_name"))).otherwise(F.col("s_name"))
    return read(spark, sf, "supplier").select("s_suppkey", sinks.labelled(name, F.col("s_suppkey") % 2 == 0).alias("label"))


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    fixed = {f: F.col("lang") for f in sinks.SUBMISSION.values()} | {f: F.col("source") for f in sinks.AUDIT_MORE}
    fixed |= {"discovery_tag": F.when(F.col("doc_id") % 2 == 0, "NEW"), "quote": F.substring("text", 1, 9), "char_start": F.col("doc_id"), "char_end": F.length("text"), "confidence": F.lit(0.5)}
    return sinks.audit(d.select(*[c.alias(k) for k, c in fixed.items()]))


# --- time, amendments and evaluation


def body_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Users' days as bodies, events as chunks."""
    e = read(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.unix_timestamp("ts").cast("double").alias("t"))
    return telemetry.body_watch(e, ["user_id", "day"], "t", ["event_id"], 30000.0, 20000.0).select("user_id", "day", "outcome", F.coalesce("cut_at", F.lit(-1.0)).alias("cut_at"), "chunks")


def renamed_terms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    ops = read(spark, sf, "supplier").select(
        (k % 20).alias("key"), k.alias("ord"), F.when(k % 7 == 0, "SECTION_OP").otherwise("GLOBAL_RENAME").alias("kind"),
        F.when(k % 3 == 0, "Thhe").when(k % 3 == 1, "").otherwise("OF THE").alias("old_term"), _cat("new ", "$s_suppkey").alias("new_term"),
    )
    c = read(spark, sf, "documents").select(F.col("doc_id").alias("citation"), (F.col("doc_id") % 25).alias("key"), F.col("text").alias("quote"))
    return currency.renamed(c, ops, _S("Act 9")).select("citation", "rename_note")


def amended_principals(spark: SparkSession, sf: str) -> DataFrame:
    deltas = _amending(spark, sf).select(_cat("d", "$key").alias("document_id"), _S("").alias("number"), _S("").alias("title"), "text")
    own = read(spark, sf, "nation").select(_cat("p", "$n_nationkey").alias("document_id"), _S("").alias("number"), _cat("Data Act ", 1990 + F.col("n_nationkey")).alias("title"), _S("1. Data is kept.").alias("text"))
    return currency.principals(deltas.unionByName(own)).select("amending_id", "key", F.coalesce("principal_id", _S("")).alias("principal_id"), "commenced")


def affected_sections(spark: SparkSession, sf: str) -> DataFrame:
    ops = currency.instructions(_amending(spark, sf)).withColumn("key", F.col("key") % 50)
    return currency.affected(ops).select("key", F.array_join("sections", ",").alias("sections"), "renames")


def verified_amendments(spark: SparkSession, sf: str) -> DataFrame:
    """A model's instructions, half of them made up, against the parser's."""
    texts = _amending(spark, sf)
    parsed = currency.instructions(texts)
    k = F.col("key")
    raw = F.when(k % 3 == 0, _S("not in the text")).otherwise(F.concat(_S("section 9A of the principal Act is "), F.when(k % 2 == 0, "deleted").otherwise("gone")))
    told = texts.select(
        k, F.lit(0).alias("ord"), _S("SECTION_OP").alias("kind"), F.when(k % 2 == 0, "delete").otherwise("amend").alias("op"), _S("9A").alias("target_section"), _S("").alias("old_term"),
        _S("").alias("new_term"), raw.alias("raw"),
    )
    return currency.verified_instructions(told, parsed, texts).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("op").alias("op"))


def gold_buckets(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("name"))
    of = lambda m: read(spark, sf, "orders").where(f"o_orderkey % {m} = 0").select(F.col("o_custkey").alias("name"))
    return evaluation.bucketed(c, of(5), of(3), of(2), "name").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def discovery_modes(spark: SparkSession, sf: str) -> DataFrame:
    targets = read(spark, sf, "customer").select(F.col("c_custkey").alias("query"), (F.col("c_custkey") % 4).alias("name"), F.col("c_mktsegment").alias("mode"), (F.col("c_custkey") % 7 == 0).alias("expect_miss"))
    results = read(spark, sf, "orders").select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 4).alias("name"), (F.col("o_orderkey") % 10).alias("rank"))
    return evaluation.discovery_scores(targets, results, 5)


def passes_united(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.array("l_linestatus", "l_returnflag")).alias("verdict"))
    return evaluation.united(x, ["l_orderkey"]).select("l_orderkey", F.array_join("verdict", ",").alias("verdict"), "succeeded")


def hidden_gold(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 300).alias("q"), (F.col("l_partkey") % 90).alias("item"), F.col("l_linenumber").alias("rank"))
    gold = read(spark, sf, "customer").select((F.col("c_custkey") % 300).alias("q"), (F.col("c_custkey") % 90).alias("item")).distinct()
    return evaluation.hidden(x, gold, ["q"], "item", 2).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


_ALL = (
    year_gate, contents_overrule_titles, working_set, web_links, answered_fetches, binding_instruments, horizontal_candidates, tidied_names, provision_lookup, page_bands,
    running_lines_gone, navigation_headers, tails_cut, cleaned_pages, page_confidence, reassembled_segments, name_slots, search_addresses, title_years, year_agreement, copy_guard,
    synonym_terms, rationales, printed_number_check, lenient_answers, clause_prompts, guidance_titles, law_classes, portal_scores, retrieval_methods, review_expectations, statute_blocks,
    section_suggestions, documents_by_content, query_floor_merge, inventory_backstop, identity_by_number, fulltext_priority, grouped_search_records, child_regulation_links,
    strategy_fallback, retry_list, guidance_documents, strategies_by_host, act_inventory, hint_attribution, discovered_instruments, follow_on_passes, register_enumeration,
    tracker_codes, tracker_prose, tracker_seeds, statute_contents, book_bodies, shared_phrases, upserted_rows, jsonld_rows, artifact_labels, audit_rows, body_cuts, renamed_terms,
    amended_principals, affected_sections, verified_amendments, gold_buckets, discovery_modes, passes_united, hidden_gold,
)
QUERIES = {f.__name__: f for f in _ALL}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_WS = r"'[ \t\n\x0B\f\r]+', ' ', 'g'"
_FURNISHED = r"""WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS page_number,
  CASE WHEN turn = 3 THEN '' ELSE 'Laws of the Realm ' || turn || chr(10) || (turn + 1) || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Section 12A' || chr(10) || 'Part 3  Offences' || chr(10) ELSE '' END
    || CASE WHEN turn >= 5 THEN 'x' ELSE text END || CASE WHEN turn >= 4 THEN chr(10) || 'Printed by the Government Printer' || chr(10) || 'Price 3.00' ELSE chr(10) || 'note' END END AS text FROM conversations)"""
_LINES = rf"""{_FURNISHED}, l AS (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS ord FROM f),
m AS (SELECT *, lower(trim(regexp_replace(line, '[0-9]+', '', 'g'))) AS norm FROM l),
e AS (SELECT *, norm <> '' AND count(*) FILTER (norm <> '') OVER g > 4 AND (sum((norm <> '')::INTEGER) OVER (g ORDER BY ord) <= 2 OR sum((norm <> '')::INTEGER) OVER (g ORDER BY ord DESC) <= 2) AS edge FROM m WINDOW g AS (PARTITION BY document_id, page_number)),
d AS (SELECT document_id, greatest(3, floor(count(DISTINCT page_number) * CAST(0.4 AS DOUBLE))) AS least, count(DISTINCT page_number) AS pages FROM l GROUP BY 1),
c AS (SELECT document_id, norm, count(DISTINCT page_number) AS n, count(DISTINCT page_number) FILTER (edge) AS n_edge FROM e WHERE norm <> '' GROUP BY 1, 2),
r AS (SELECT e.*, coalesce(n >= least AND pages >= 4, false) AS repeats, coalesce(n_edge >= least AND pages >= 4, false) AS placed FROM e JOIN d USING (document_id) LEFT JOIN c USING (document_id, norm)),
x AS (SELECT *, (repeats AND length(norm) >= 10) OR (placed AND edge) AS runs, length(trim(line)) <= 12 AND (regexp_matches(line, '^\s*\d{{1,4}}\s*$') OR repeats OR regexp_matches(trim(line), '(?i)^\d{{0,4}}\s*ed\.?$')) AS short FROM r),
y AS (SELECT *, coalesce(last_value(CASE WHEN runs OR NOT short THEN runs END IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  OR coalesce(lead(runs) OVER (PARTITION BY document_id, page_number ORDER BY ord), false) AS touches FROM x),
z AS (SELECT *, runs OR (short AND touches) AS gone FROM y)"""
_NAV = r"(trim(line) <> '' AND NOT regexp_matches(trim(line), '[—–]') AND (regexp_matches(trim(line), '^(?:Section|Clause)\s+\d+[A-Z]*$') OR (contains(trim(line), '  ') AND len(list_filter(regexp_split_to_array(trim(line), '\s{2,}'), lambda c: trim(c) <> '')) = 2 AND len(list_filter(regexp_split_to_array(trim(line), '\s{2,}'), lambda c: regexp_matches(trim(c), '^(?:Part|Division|Schedule)\s+[0-9IVXLC]+[A-Z]?$'))) > 0)))"
_TAIL_RE = r"(?im)^[ \t]*(?:printed\s+by|government\s+printer)\b"


def _cut(source: str) -> str:
    """Pages of `source` without their tails, as t."""
    return rf"""a AS (SELECT *, regexp_matches(text, '{_TAIL_RE}') AS marked FROM {source}),
b AS (SELECT *, coalesce(max(page_number) FILTER (trim(text) <> '' AND NOT marked) OVER (PARTITION BY document_id), -1) AS last FROM a),
h AS (SELECT *, min(page_number) FILTER (marked AND page_number > last) OVER (PARTITION BY document_id) AS first FROM b),
k AS (SELECT *, regexp_split_to_array(text, '{_TAIL_RE}')[1] AS head FROM h),
t AS (SELECT document_id, page_number, CASE WHEN first IS NULL OR page_number < first THEN text WHEN page_number > first THEN '' WHEN regexp_matches(head, '[.;]') THEN regexp_replace(head, '\s+$', '') ELSE '' END AS text FROM k)"""


_STARTS = "coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_AMENDING = "SELECT o_orderkey AS key FROM orders"
ORACLE_SQL = {
    "year_gate": "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 <> 0 AND year(o_orderdate) <= 1990 + o_orderkey % 10)",
    "contents_overrule_titles": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN false WHEN p_partkey % 3 = 1 THEN true ELSE p_partkey % 2 = 0 END AS kept FROM part",
    "working_set": "SELECT 'ring' AS asked, p_partkey FROM part WHERE contains(lower(p_name), 'ring') UNION ALL SELECT 'qqq', p_partkey FROM part",
    "web_links": "SELECT page_id FROM pages WHERE page_id % 4 <> 0",
    "answered_fetches": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 <> 0) AND doc_id % 3 <> 0 AND length(text) > 0",
    "binding_instruments": f"SELECT s_suppkey, {_list(_AGREED)}[s_suppkey % 5 + 1] AS name FROM supplier WHERE s_suppkey % 5 IN (1, 4)",
    "horizontal_candidates": "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)",
    "tidied_names": """WITH c AS (SELECT c_nationkey, c_custkey AS ord, CASE c_custkey % 7 WHEN 0 THEN 'Data Act 2001' WHEN 3 THEN 'Data Act 2001' WHEN 4 THEN 'Privacy Ordinance' END AS name FROM customer)
SELECT c_nationkey, name, min(ord) AS ord FROM c WHERE name IS NOT NULL GROUP BY 1, 2""",
    "provision_lookup": """WITH r AS (SELECT lower(c_mktsegment) AS segment, CAST(c_nationkey AS VARCHAR) AS nation, min(c_name) AS quote FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
s AS (SELECT CAST(n_nationkey AS VARCHAR) AS nation, unnest(['building', 'none']) AS segment FROM nation) SELECT segment, nation, coalesce(quote, 'NO PROVISION FOUND') AS quote FROM s LEFT JOIN r USING (segment, nation)""",
    "page_bands": "WITH n AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS n FROM documents) SELECT doc_id, CAST(CASE WHEN n > 4 THEN 4 ELSE 0 END AS BIGINT) AS edge, n FROM n WHERE n > 0",
    "running_lines_gone": f"{_LINES} SELECT document_id, page_number, count(*) AS n, CAST(sum(ord) AS BIGINT) AS places FROM z WHERE NOT gone GROUP BY 1, 2",
    "navigation_headers": f"{_LINES} SELECT line, count(*) AS n FROM l WHERE {_NAV} GROUP BY 1",
    "tails_cut": f"{_FURNISHED}, {_cut('f')} SELECT document_id, page_number, CAST(length(text) AS INTEGER) AS n, CAST({_STARTS} + length(text) AS INTEGER) AS char_end FROM t",
    "cleaned_pages": f"""{_LINES}, j AS (SELECT document_id, page_number, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone AND NOT {_NAV}), '') AS text FROM z GROUP BY 1, 2), {_cut('j')}
SELECT document_id, page_number, text, CAST({_STARTS} AS INTEGER) AS char_start, CAST({_STARTS} + length(text) AS INTEGER) AS char_end FROM t""",
    "page_confidence": "SELECT conv_id AS document_id, coalesce(round(avg((turn * 7 + conv_id) % 10 / CAST(10 AS DOUBLE)) FILTER (turn % 3 <> 0 AND trim(text) <> ''), 4), CAST(-1 AS DOUBLE)) AS ocr_confidence FROM conversations GROUP BY 1",
    "reassembled_segments": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY 1",
    "name_slots": rf"""WITH t AS (SELECT s_suppkey, ' Law  of ' || s_name || {_list(_SHELLS)}[s_suppkey % 5 + 1] AS title FROM supplier)
SELECT s_suppkey, substring(trim(regexp_replace(title, '(?is)(current version|repealed|reprint).*$', '')), 1, 90) AS slot, trim(regexp_replace(regexp_replace(title, '(?is)\s+Current version as at\b.*$', ''), {_WS})) AS name, true AS is_file FROM t""",
    "search_addresses": "SELECT p_partkey, 'https://h/s?q=' || url_encode(p_name || ' & é') || '&p=1' AS address FROM part",
    "title_years": """WITH t AS (SELECT p_partkey AS k, 1990 + p_partkey % 30 AS a, 2000 + p_partkey % 3 AS b, CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_partkey % 7 END AS c FROM part)
SELECT k AS p_partkey, a || ',' || b AS years, coalesce(c NOT IN (a, b), false) AS conflict FROM t""",
    "year_agreement": "SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 9 = o_orderkey % 6 AS agrees FROM orders",
    "copy_guard": """WITH w AS (SELECT doc_id, string_split(text, ' ')[1:8] AS w, lower(CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 60) ELSE 'none of it' END) AS s FROM documents)
SELECT doc_id, len(list_filter(range(0, greatest(len(w) - 5, 0)), lambda i: contains(s, lower(array_to_string(w[i + 1:i + 6], ' '))))) > 0 AS copied FROM w""",
    "rationales": """WITH b AS (SELECT p_partkey, lower(p_name) AS t, CASE WHEN p_partkey % 4 = 0 THEN 'This provision' ELSE 'Section ' || p_partkey END || ' maps to P6-I1 (Bans).' AS b FROM part),
h AS (SELECT *, list_filter(['ring', 'RED', 'bolt'], lambda p: contains(t, lower(p))) AS h FROM b),
s AS (SELECT *, b || ' Indicator concept(s) present: ' AS pre, '''' || h[1] || '''' AS one, '''' || h[1] || '''; ''' || h[2] || '''' AS two FROM h)
SELECT p_partkey, CASE WHEN len(h) > 1 AND length(pre || two) + 1 <= 75 THEN pre || two || '.' WHEN len(h) > 0 AND length(pre || one) + 1 <= 75 THEN pre || one || '.' ELSE b END AS rationale FROM s""",
    "printed_number_check": "SELECT doc_id, doc_id % 3 <> 0 AND contains(text, CAST(doc_id % 100 AS VARCHAR)) AS printed FROM documents",
    "lenient_answers": "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 < 3 THEN CAST(turn AS VARCHAR) ELSE '' END AS a FROM conversations",
    "clause_prompts": """WITH p AS (SELECT item_id, replace(trim(text), chr(10), ' ') AS t FROM benchmark),
q AS (SELECT item_id, 'INDICATORS:' || chr(10) || 'I1: bans' || chr(10) || chr(10) || 'CLAUSE (Section ' || item_id || '):' || chr(10) || CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || ' …' ELSE t END AS prompt FROM p)
SELECT item_id, prompt, sha256('judge' || chr(2) || prompt) AS fingerprint FROM q""",
    "guidance_titles": """SELECT s_suppkey, ['On Data', 'Guide to é', 'Tools 1 Jan 2001', 'Plain Title', 'Practical Guidance on 5 May 2020 x'][s_suppkey % 5 + 1] AS title,
['Advisory Guidelines 12 May 2020 On Data', '3 June 2019   Guide to ?', 'Tools 1 Jan 2001 ', 'Plain Title', 'Practical Guidance on 5 May 2020 x'][s_suppkey % 5 + 1] AS shown FROM supplier""",
    "law_classes": """SELECT s_suppkey, ['PDPA', 'PDPA', '', 'CMA', 'CRIMINAL', 'PDPA', '', ''][s_suppkey % 8 + 1] AS law,
['', 'Personal Data Protection', 'Personal Data Code of Practice', 'Communications', 'The Penal Code', 'Order A1727', '', 'Other Law'][s_suppkey % 8 + 1] AS core FROM supplier""",
    "synonym_terms": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Ring|t' || p_partkey || '|a b' END AS terms FROM part",
    "portal_scores": """SELECT l_orderkey, l_linenumber, round(CAST(0.8 AS DOUBLE) * (l_discount * 5) + CASE WHEN l_returnflag = 'R' THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 6) AS register,
round(CAST(0.4 AS DOUBLE) * (l_discount * 5) + CAST(0.4 AS DOUBLE) * l_tax + CASE WHEN l_returnflag = 'R' THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 6) AS search FROM lineitem""",
    "retrieval_methods": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'bm25+dense' ELSE 'bm25' END || CASE WHEN p_partkey % 3 = 0 THEN '+llm-per-clause' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '+llm-flagged' ELSE '' END AS method, count(*) AS n FROM part GROUP BY 1",
    "review_expectations": "SELECT s_suppkey, ['KEEP', 'DROP', 'EITHER'][s_suppkey % 3 + 1] AS expected, CASE WHEN s_suppkey % 2 = 0 THEN 'P' || (s_suppkey % 12) ELSE 'P7' END AS pillar, CASE WHEN s_suppkey % 4 = 0 THEN 'my' ELSE '??' END AS iso FROM supplier",
    "statute_blocks": rf"""WITH c AS (SELECT conv_id, turn, turn // 2 AS s, trim(regexp_replace(text || ' ' || chr(10) || ' x', {_WS})) AS t FROM conversations),
g AS (SELECT conv_id, s, min(turn) AS pos, string_agg(t, ' ' ORDER BY turn) AS whole, arg_min(t, turn) AS first FROM c GROUP BY 1, 2)
SELECT conv_id, string_agg('s' || s || ': ' || substring(first, 1, 30), chr(10) ORDER BY pos) AS block, md5(string_agg('s' || s || ': ' || whole, chr(10) ORDER BY pos)) AS whole FROM g GROUP BY 1""",
    "section_suggestions": """WITH t AS (SELECT DISTINCT l_orderkey % 60 AS iso, l_linenumber AS section, l_returnflag AS indicator FROM lineitem), s AS (SELECT DISTINCT c_custkey % 70 AS iso, c_custkey % 11 AS section FROM customer),
n AS (SELECT iso, indicator, count(*) AS n FROM t JOIN s USING (iso, section) GROUP BY 1, 2)
SELECT iso, indicator, '### ' || indicator || ' law ' || iso || chr(10) || 'candidates: ' || n || chr(10) || 'VERDICT: KEEP/DROP' || chr(10) || 'NOTE:' || chr(10) AS block FROM n""",
    "documents_by_content": """WITH d AS (SELECT lang AS iso, CAST(doc_id AS VARCHAR) AS document_id, upper(substring(text, 1, 400)) AS h, length(text) AS n FROM documents),
m AS (SELECT 'TION, the ' AS needles, * FROM d WHERE contains(h, 'TION') AND contains(h, ' THE ') UNION ALL SELECT 'de', * FROM d WHERE contains(h, 'DE'))
SELECT iso, needles, document_id FROM m QUALIFY row_number() OVER (PARTITION BY iso, needles ORDER BY n DESC, document_id DESC) = 1""",
    "query_floor_merge": """WITH c AS (SELECT c_mktsegment || c_nationkey AS q, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 50 END AS floor FROM customer)
SELECT q, CASE WHEN count(*) > count(floor) THEN -1 ELSE min(floor) END AS floor FROM c GROUP BY q""",
    "inventory_backstop": "SELECT p_partkey AS act_no, CAST(1 AS DOUBLE) AS score, 'KNOWN' AS tag FROM part WHERE p_size < 10 AND p_partkey % 3 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "identity_by_number": "SELECT s_suppkey, CASE WHEN n_name IS NOT NULL THEN 'KNOWN' WHEN s_suppkey % 2 = 0 THEN 'NEW' ELSE '' END AS tag, coalesce(n_name, '') AS matched FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 40",
    "fulltext_priority": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'e' WHEN page_id % 3 = 0 THEN url WHEN page_id % 5 = 0 THEN 'r' ELSE 'p' END AS fulltext FROM pages",
    "grouped_search_records": """WITH x AS (SELECT l_orderkey % 100 AS query, l_partkey % 50 AS act_id, l_orderkey * 10 + l_linenumber AS idx, bool_or(l_returnflag = 'R') AS principal, 'T' || min(l_suppkey) AS title,
  CASE WHEN l_linenumber % 2 = 0 THEN 'f' || min(l_partkey) END AS fulltext, 'u' || l_orderkey || '-' || l_linenumber AS url FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey % 50)
SELECT query, act_id, round(max(greatest(0, 1 - idx / CAST(1000000 AS DOUBLE))), 6) AS relevance, bool_or(principal) AS principal, (list(title ORDER BY length(title) DESC, idx))[1] AS title,
  coalesce(arg_min(fulltext, idx) FILTER (fulltext IS NOT NULL), '') AS fulltext, (list(url ORDER BY principal DESC, idx))[1] AS url, count(*) AS n_records FROM x GROUP BY 1, 2""",
    "child_regulation_links": """WITH m AS (SELECT n_nationkey AS act_id, c_custkey AS title_id, 'Rules of nation_' || (c_custkey % 25) AS name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT act_id, title_id, name, CAST(row_number() OVER (PARTITION BY act_id ORDER BY name, title_id) AS INTEGER) AS place FROM m WHERE contains(lower(name), lower(n_name)) QUALIFY place <= 5""",
    "strategy_fallback": """WITH s AS (SELECT c_nationkey AS portal, c_name AS item FROM customer WHERE c_custkey % 60 = 1)
SELECT * FROM s UNION ALL SELECT s_nationkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT portal FROM s)""",
    "retry_list": "SELECT user_id % 5 AS portal, user_id AS query, min(event_id) AS ord FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2",
    "guidance_documents": r"""WITH p AS (SELECT regexp_replace(url, '[0-9]+([?#].*)?$', '') AS href, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, page_id FROM pages)
SELECT href, (list(t ORDER BY length(t) DESC, page_id))[1] AS title FROM p WHERE contains(lower(t), 'the') GROUP BY 1""",
    "strategies_by_host": """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages)
SELECT host, CASE WHEN contains(host, 'thth') THEN 'concept' WHEN contains(host, 'example.com') THEN 'search' WHEN contains(host, '.net') THEN 'connector' ELSE '' END AS strategy FROM h""",
    "act_inventory": """WITH f AS (SELECT p_partkey % 150 AS act_no, p_partkey AS o, p_name, p_size > 25 AS malay, CASE p_partkey % 4 WHEN 0 THEN '2001' WHEN 1 THEN ' ' END AS c, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey END AS pdf FROM part),
m AS (SELECT act_no, (list(p_name ORDER BY malay, o))[1] AS title, arg_min(c, o) FILTER (trim(coalesce(c, '')) <> '') AS commencement, arg_min(pdf, o) FILTER (pdf IS NOT NULL) AS pdf, count(*) AS feeds FROM f GROUP BY 1),
r AS (SELECT s_suppkey * 7 % 170 AS act_no, CAST(max(s_suppkey) AS VARCHAR) AS repealed_by FROM supplier GROUP BY 1)
SELECT act_no, coalesce(title, '') AS title, coalesce(commencement, '') AS commencement, coalesce(pdf, '') AS pdf, CAST(coalesce(feeds, 0) AS INTEGER) AS feeds, coalesce(repealed_by, '') AS repealed_by, repealed_by IS NOT NULL AS repealed,
  repealed_by IS NULL AND coalesce(commencement, '') <> '' AS in_force FROM m FULL JOIN r USING (act_no)""",
    "hint_attribution": "SELECT p_partkey AS id, concat_ws(',', CASE WHEN contains(p_name, 'ring') THEN 'P6-I1' END, CASE WHEN contains(p_name, 'widget') THEN 'P6-I2' END, CASE WHEN contains(p_name, 'ring') OR p_name = 'blue bolt' THEN 'P7-I1' END) AS indicators FROM part",
    "follow_on_passes": """WITH e AS (SELECT 0 AS p, 'a' || (s_suppkey % 80) AS key, 'supplier ' || s_suppkey AS title, 1990 + s_suppkey % 30 AS year, s_suppkey % 3 AS query, 'main' AS found_in FROM supplier
  UNION ALL SELECT 1, 'a' || (c_custkey % 500), 'customer ' || c_custkey, 1990 + c_custkey % 30, c_custkey % 3, 'amendments' FROM customer
  UNION ALL SELECT 2, 'a' || (p_partkey % 700), 'part ' || p_partkey, 1990 + p_partkey % 30, p_partkey % 3, 'children' FROM part)
SELECT key, title, CAST(year AS INTEGER) AS year, query, found_in FROM e WHERE p = 0 OR query <> 0 OR year > 2000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY p, title, year, query) = 1""",
    "register_enumeration": """WITH v AS (SELECT p_partkey AS k, p_partkey % 10 <> 0 AS judged, p_partkey % 3 AS t, p_partkey % 4 = 0 AS second, p_partkey % 8 = 0 AS hit FROM part)
SELECT k AS act_no, CASE WHEN NOT judged OR t = 2 THEN '' WHEN t = 1 THEN 'P6-I1,P7-I3' WHEN NOT second THEN 'P7-I3' WHEN hit THEN 'P7-I5' ELSE '' END AS indicators,
  CASE WHEN NOT judged THEN 'pending' WHEN t = 0 AND NOT second THEN 'second' ELSE 'done' END AS stage, judged AND (t = 1 OR (t = 0 AND (NOT second OR hit))) AS keep FROM v""",
    "tracker_codes": """WITH c AS (SELECT 'N' || s_suppkey AS economy, unnest(['P6-I1', 'P6-I2', 'P7-I1']) AS indicator, unnest([s_suppkey % 3, s_suppkey % 3, s_suppkey % 4]) AS code FROM supplier),
p AS (SELECT economy, indicator, CASE code WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'unknown' END AS presence FROM c) SELECT *, 'tracker: ' || presence AS note FROM p""",
    "tracker_prose": rf"""WITH b AS (SELECT conv_id AS page, turn, text FROM conversations WHERE length(text) > 20 AND regexp_matches(text, '(?i)\b(the|de|of)\b') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2)
SELECT page, substring(trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\s+', ' ', 'g')), 1, 100) AS text FROM b GROUP BY 1""",
    "tracker_seeds": """WITH s AS (SELECT CAST(c_nationkey AS VARCHAR) AS economy, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS law FROM customer WHERE c_custkey % 3 = 0)
SELECT economy, min(law) AS law FROM s WHERE law <> '' GROUP BY economy, lower(law)""",
    "statute_contents": f"""WITH d AS (SELECT doc_id AS k, substring(text, 1, 500) || CASE WHEN doc_id % 2 = 0 THEN ' Arrangement of Sections ' ELSE '' END || substring(text, 501, 300) AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '[a-z]{{2,}}') AS ws, strpos(replace(upper(replace(t, 'ß', 'SS')), ' ', ''), 'ARRANGEMENTOFSECTIONS') AS pos FROM d),
r AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'no-pdf-link' WHEN k % 7 = 0 THEN 'http-404' WHEN k % 5 = 0 THEN 'not-a-pdf' WHEN length(trim(t)) < 300 THEN 'no-text-layer'
  WHEN k % 3 = 0 AND NOT (len(ws) >= 120 AND len(list_filter(ws, lambda x: x IN ({', '.join(repr(x) for x in rules.FUNCTION_WORDS)}))) >= CAST(0.1 AS DOUBLE) * len(ws)) THEN 'ocr-illegible' ELSE '' END AS reason FROM w)
SELECT k AS doc_id, reason, md5(CASE WHEN reason <> '' THEN '' WHEN pos > 0 THEN substring(t, greatest(pos - 200, 1), pos - greatest(pos - 200, 1) + 12000) ELSE substring(t, 1, 12000) END) AS text FROM r""",
    "book_bodies": r"SELECT page_id, md5(CASE WHEN regexp_matches(html, '(?is)<body\b[^>]*>.*</body\s*>') THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*)</body\s*>', 1) ELSE html END) AS body FROM pages",
    "shared_phrases": "SELECT p_brand AS iso, p_name AS phrase, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS indicators FROM part GROUP BY 1, 2",
    "upserted_rows": """WITH n AS (SELECT o_custkey AS key, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT key FROM n)""",
    "jsonld_rows": """SELECT '{"@context":"http://x/v#","s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS value FROM supplier""",
    "artifact_labels": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 THEN 'DEMO_' ELSE '' END || s_name AS label FROM supplier",
    "audit_rows": "SELECT " + ", ".join(
        [{"discovery_tag": "CASE WHEN doc_id % 2 = 0 THEN 'NEW' ELSE 'KNOWN' END", "quote": "substring(text, 1, 9)", "confidence": "CAST(0.5 AS DOUBLE)"}.get(f, "lang") + f' AS "{c}"' for c, f in sinks.SUBMISSION.items()]
        + [{"char_start": "doc_id", "char_end": "CAST(length(text) AS INTEGER)"}.get(f, "source") + f" AS {f}" for f in sinks.AUDIT_MORE]
    ) + " FROM documents",
    "body_cuts": """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, floor(epoch(ts)) AS t FROM events),
s AS (SELECT *, min(t) OVER (PARTITION BY user_id, day) AS first, lag(t) OVER (PARTITION BY user_id, day ORDER BY t, event_id) AS before FROM e),
m AS (SELECT *, CASE WHEN t - before > 20000 THEN before + 20000 END AS silent, CASE WHEN t - first > 30000 THEN first + 30000 END AS late FROM s),
q AS (SELECT *, min(silent) OVER (PARTITION BY user_id, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quiet FROM m),
g AS (SELECT user_id, day, min(silent) AS silent, min(late) AS late, count(*) FILTER (quiet IS NULL AND late IS NULL) AS chunks FROM q GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN silent IS NULL AND late IS NULL THEN 'DONE' WHEN silent <= coalesce(late, silent) THEN 'IDLE' ELSE 'DEADLINE' END AS outcome, CAST(coalesce(least(silent, late), -1) AS DOUBLE) AS cut_at, chunks FROM g""",
    "renamed_terms": """WITH o AS (SELECT s_suppkey % 20 AS key, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'Thhe' ELSE 'OF THE' END AS old FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 1),
m AS (SELECT doc_id, arg_min('term "' || old || '" renamed to "new ' || ord || '" by Act 9', ord) AS note FROM documents JOIN o ON key = doc_id % 25 AND contains(lower(text), lower(old)) GROUP BY 1)
SELECT d.doc_id AS citation, coalesce(note, '') AS rename_note FROM documents AS d LEFT JOIN m ON m.doc_id = d.doc_id""",
    "amended_principals": f"""SELECT 'd' || key AS amending_id, 'title:data act ' || (1990 + key % 30) AS key, CASE WHEN key % 30 < 25 THEN 'p' || (key % 30) ELSE '' END AS principal_id, true AS commenced FROM ({_AMENDING}) WHERE key % 3 = 0""",
    "affected_sections": f"""WITH s AS (SELECT key % 50 AS key, unnest([CAST(key AS VARCHAR), '9A', '7']) AS s FROM ({_AMENDING})) SELECT key, string_agg(DISTINCT s, ',' ORDER BY s) AS sections, false AS renames FROM s GROUP BY 1""",
    "verified_amendments": f"""SELECT key, CASE WHEN key % 3 <> 0 AND key % 2 = 0 THEN 1 ELSE 3 END AS n, CASE WHEN key % 3 <> 0 AND key % 2 = 0 THEN 'delete' WHEN key % 2 <> 0 THEN 'amend' ELSE 'delete' END AS op FROM ({_AMENDING})""",
    "gold_buckets": """SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) THEN 'kept' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) THEN 'truncated'
WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) THEN 'secondary' ELSE 'not_found' END AS bucket, count(*) AS n FROM customer GROUP BY 1""",
    "discovery_modes": """WITH m AS (SELECT c_custkey, c_mktsegment AS mode, c_custkey % 7 = 0 AS miss, count(o_orderkey) > 0 AS hit FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 4 = c_custkey % 4 AND o_orderkey % 10 <= 5 GROUP BY ALL)
SELECT mode, count(*) AS queries, count(*) FILTER (hit) AS found, count(*) FILTER (hit <> miss) AS as_expected FROM m GROUP BY mode""",
    "passes_united": """WITH u AS (SELECT l_orderkey, unnest([l_linestatus, l_returnflag]) AS v FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS verdict, count(v) > 0 AS succeeded FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN u USING (l_orderkey) GROUP BY 1""",
    "hidden_gold": """WITH r AS (SELECT l_orderkey % 300 AS q, l_partkey % 90 AS item, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT c_custkey % 300 AS q, c_custkey % 90 AS item FROM customer)
SELECT CASE WHEN rank IS NULL THEN 'out of pool' WHEN rank <= 2 THEN 'shown' ELSE 'below' END AS place, count(*) AS n FROM g LEFT JOIN r USING (q, item) GROUP BY 1""",
}
