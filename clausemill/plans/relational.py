"""Queries over the relational tables and events: joins, merges, currency, reports, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, scoring
from ..operators import currency, merge, reports, telemetry
from .retrieval import read


def known_first_budget(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    kept = merge.known_first(c, F.col("c_mktsegment") == "BUILDING", ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)
    return kept.select("c_custkey", "c_nationkey", "c_mktsegment")


def merge_best_wins_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    merged = merge.best_wins(o, "o_custkey", "o_totalprice", "o_orderkey", ["o_orderstatus", "o_orderkey"], ["note"], F.col("o_orderstatus") == "F")
    return merged.withColumn("note", F.coalesce("note", F.lit("")))


def citation_first_seen_dedup(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("clause"), "l_orderkey", "l_linenumber", "l_quantity")
    return merge.first_seen(x, ["l_suppkey", "clause"], ["l_orderkey", "l_linenumber"])


def resumable_last_line(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return merge.last_seen(e, ["user_id", "event_type"], ["event_id"])


def coverage_grid_dense(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    kinds = spark.sql("SELECT * FROM VALUES ('AUTOMOBILE'), ('BUILDING'), ('NONE') AS t(segment)")
    c = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return reports.dense_grid(n, kinds, c, ["n_nationkey", "segment"], "n")


def gap_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select("p_partkey", "p_brand")
    return merge.missing_from(p, read(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


def name_gap_bidirectional(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "part").select("p_name").union(read(spark, sf, "part").select("p_type")).toDF("name").distinct()
    found = read(spark, sf, "part").where("p_size < 5").select("p_name").union(read(spark, sf, "part").where("p_size = 7").select("p_type")).toDF("have").distinct()
    return reports.name_gaps(names, found, "name", "have")


def _chain_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 100).alias("key"), (2000 + F.col("event_id") % 25).cast("int").alias("year"),
        F.when(F.col("event_type") == "click", "").otherwise(F.concat(F.lit("Act "), (F.col("event_id") % 7).cast("string"))).alias("amending_id"),
        F.col("event_type").alias("title"),
        F.when(F.col("event_type") == "view", "corpus").when(F.col("event_type") == "signup", "portal").otherwise("registry").alias("detected_by"),
        F.col("event_id").alias("ord"),
    )


def amendment_chain(spark: SparkSession, sf: str) -> DataFrame:
    return currency.chain(_chain_events(spark, sf)).select("key", "year", "amending_id", "detected_by")


def _instruments(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("key"), F.when(F.col("c_custkey") % 4 != 0, (2000 + F.col("c_custkey") % 25).cast("int")).alias("cutoff"))


def asof_missing_events(spark: SparkSession, sf: str) -> DataFrame:
    m = currency.missed(_instruments(spark, sf), currency.chain(_chain_events(spark, sf)).select("key", "year"))
    status = currency.document_status(F.col("n_events"), F.col("n_missed"), F.lit("ORIGINAL"))
    return m.withColumn("cutoff", F.coalesce("cutoff", F.lit(-1))).withColumn("status", status)


def currency_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = asof_missing_events(spark, sf).withColumn("economy", F.concat(F.lit("e"), (F.col("key") % 3).cast("string")))
    rolled = s.rollup("economy", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return rolled.select(F.coalesce("economy", F.lit("all")).alias("economy"), F.coalesce("status", F.lit("all")).alias("status"), "n").distinct()


def adjudicate_precedence(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem")
    ops = x.select(
        (F.col("l_orderkey") % 50).alias("key"), (F.col("l_partkey") % 2000).cast("string").alias("target_section"),
        F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "amend").otherwise("insert").alias("op"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("raw"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    cites = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("citation"), (F.col("c_custkey") % 50).alias("key"), F.when(F.col("c_custkey") % 9 == 0, "").otherwise((F.col("c_custkey") % 2500).cast("string")).alias("section"),
        (F.col("c_custkey") % 2 == 0).alias("commenced"),
    )
    return currency.adjudicated(cites, ops).select("citation", "key", "section", F.coalesce("status", F.lit("")).alias("status"), F.md5(F.col("amendment_text").cast("binary")).alias("text_md5"))


def or_keys_match(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("citation"), F.array(F.concat(F.lit("act:"), (F.col("c_custkey") % 90).cast("string")), F.concat(F.lit("title:"), (F.col("c_custkey") % 80).cast("string"))).alias("keys"))
    e = read(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, "act:").otherwise("title:"), (F.col("s_suppkey") % 95).cast("string")).alias("key"),
        (2000 + F.col("s_suppkey") % 20).cast("int").alias("year"), F.lit("x").alias("amending_id"),
    )
    return currency.events_for(c, e)


def rate_spacing_schedule(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("t"))
    s = telemetry.spaced(e, "user_id", "t", ["event_id"], 3600.0)
    return s.select("event_id", F.round("starts", 3).alias("starts"), F.round("wait", 3).alias("wait"))


def circuit_breaker_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return telemetry.failure_runs(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "click"), 3).select("event_id", "run", "open")


def degrade_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return telemetry.degraded(e, ["user_id"], F.col("event_type").isin("error", "click", "view"))


def stall_intervals(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return telemetry.stalls(e, ["user_id"], "ts", ["event_id"], 1500).select("event_id", "gap", "reports")


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.heartbeat(
        read(spark, sf, "events"), "ts", "hour", {"calls": F.count(F.lit(1)), "failed": F.count_if(F.col("event_type") == "error"), "spent": F.sum(F.round(F.col("value") * 100).cast("long"))}
    )


def heartbeat_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _ticks(spark, sf).withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH"))


def budget_alarm(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.budget_alarm(_ticks(spark, sf).select(F.date_format("tick", "yyyy-MM-dd HH").alias("tick"), "total_spent"), "total_spent", 100000.0)


def echo_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select((F.col("user_id") % 5).alias("portal"), F.col("user_id").alias("query"), F.col("event_type").alias("item"), "event_id")
    first = merge.first_seen(e, ["portal", "query"], ["event_id"])
    return telemetry.echoes(first, "portal", "query", "event_id", "item")


def ttl_cache_valid(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    made = F.unix_timestamp("o_orderdate").cast("double")
    return o.select("o_orderkey", keys.still_valid(F.lit(870000000.0), made, F.lit(24.0 * 365), F.col("o_orderkey") % 5 == 0).alias("valid"))


def cache_miss_anti(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", keys.composite_key(F.lit("m1"), F.col("lang"), F.col("text")).alias("key"))
    held = d.where("doc_id % 3 = 0").select("key").distinct()
    return merge.missing_from(d, held, ["key"])


def cache_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2").alias("model"), (F.col("doc_id") % 3).alias("fingerprint"))
    return d.groupBy("model").agg(F.count_if(F.col("fingerprint") == 0).alias("live"), F.count(F.lit(1)).alias("total"))


def replay_lookup(spark: SparkSession, sf: str) -> DataFrame:
    q = read(spark, sf, "pages").select("page_id", keys.composite_key(F.lit("GET"), F.col("url")).alias("key"))
    recorded = q.where("page_id % 4 <> 0").select("key", F.lit(200).alias("status")).distinct()
    return telemetry.replayed(q, recorded).select("page_id", "status", "miss")


def cost_ledger_nullable(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_type").alias("model"), F.floor(F.col("event_id") / 5).alias("run"), F.col("event_id"))
    rates = spark.sql("SELECT * FROM VALUES ('click', 2.0D, 1.0D, 8.0D), ('view', 3.0D, 1.0D, 4.0D), ('error', 1.0D, 1.0D, 1.0D), ('signup', 3.0D, 1.0D, 9.0D) AS t(model, a, b, c)")
    price = scoring.cost(F.col("event_id") % 1000, F.col("event_id") % 1500, F.col("event_id") % 100, F.col("a"), F.col("b"), F.col("c"))
    return reports.priced(e, rates, "model", price, ["run"]).withColumn("cost", F.coalesce("cost", F.lit(-1.0)))


def confusion_micro(spark: SparkSession, sf: str) -> DataFrame:
    lab = read(spark, sf, "labels")
    gold = lab.where("quality = 1").select((F.col("doc_id") % 4).alias("g"), "doc_id")
    said = read(spark, sf, "documents").where("n_chars > 1500").select((F.col("doc_id") % 4).alias("g"), "doc_id")
    return reports.confusion(gold, said, ["g"], ["doc_id"])


def na_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for groups whose gold is asserted empty."""
    empty = spark.sql("SELECT * FROM VALUES ('src1'), ('src3'), ('srcX') AS t(source)")
    said = read(spark, sf, "documents").where("n_chars > 3000").select("source", "doc_id")
    return empty.join(said, "source", "left").groupBy("source").agg(F.count("doc_id").alias("violations"))


def multihit_groups(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag")
    return reports.multi_hit(x, ["l_partkey", "l_linestatus"], "l_returnflag")


def cooccurrence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 12).alias("i"))
    return reports.co_occurrence(x, ["l_orderkey"], "i").orderBy(F.col("n").desc(), "a", "b").limit(12)


def interval_merge_columns(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select((F.col("user_id") % 20).alias("page"), (F.unix_timestamp("ts") - 1704067200).alias("x0"), (F.unix_timestamp("ts") - 1704067200 + 1800).alias("x1"))
    return reports.merged_intervals(e, ["page"], "x0", "x1")


def pass_stability(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "lineitem")
    return reports.stability(x, ["l_orderkey"], "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(F.col("stable").cast("int")), 1).alias("stable_pct"))


def review_agreement(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "labels")
    return reports.agreement(x, F.col("toxic").isNotNull(), F.col("toxic") == 1 - F.col("quality"), [])


def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").groupBy(F.session_window("ts", "1500 seconds").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("n").agg(F.count(F.lit(1)).alias("sessions"))


def instruction_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_partkey") % 500).alias("k"), "l_returnflag")
    b = read(spark, sf, "lineitem").where("l_linenumber = 2").select((F.col("l_partkey") % 500).alias("k"), "l_returnflag")
    tag = lambda df, t: df.select(F.lit(t).alias("side"), "k", "l_returnflag")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "left")).unionByName(tag(b.subtract(a), "right"))


_ALL = (
    known_first_budget, merge_best_wins_coalesce, citation_first_seen_dedup, resumable_last_line, coverage_grid_dense, gap_anti_join, name_gap_bidirectional,
    amendment_chain, asof_missing_events, currency_status_rollup, adjudicate_precedence, or_keys_match, rate_spacing_schedule, circuit_breaker_runs,
    degrade_gate, stall_intervals, heartbeat_totals, budget_alarm, echo_fingerprints, ttl_cache_valid, cache_miss_anti, cache_coverage, replay_lookup,
    cost_ledger_nullable, confusion_micro, na_violations, multihit_groups, cooccurrence_pairs, interval_merge_columns, pass_stability, review_agreement,
    tumbling_counts, sliding_counts, session_counts, instruction_diff,
)
QUERIES = {f.__name__: f for f in _ALL}

_CHAIN = """WITH e AS (SELECT user_id % 100 AS key, CAST(2000 + event_id % 25 AS INTEGER) AS year, CASE WHEN event_type = 'click' THEN '' ELSE 'Act ' || (event_id % 7) END AS amending_id,
  CASE event_type WHEN 'view' THEN 'corpus' WHEN 'signup' THEN 'portal' ELSE 'registry' END AS detected_by, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS r, event_id FROM events),
o AS (SELECT key, year, amending_id, (list(detected_by ORDER BY r, event_id))[1] AS detected_by FROM e GROUP BY 1, 2, 3),
c AS (SELECT * FROM o QUALIFY amending_id <> '' OR NOT bool_or(amending_id <> '') OVER (PARTITION BY key, year))"""
_ASOF = _CHAIN + """, i AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 <> 0 THEN CAST(2000 + c_custkey % 25 AS INTEGER) END AS cutoff FROM customer),
m AS (SELECT i.key, coalesce(cutoff, -1) AS cutoff, count(year) AS n_events, count(*) FILTER (year > coalesce(cutoff, -1)) AS n_missed,
  coalesce(string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FILTER (year > coalesce(cutoff, -1)), '') AS missed_years FROM i LEFT JOIN c ON c.key = i.key GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN n_missed > 0 THEN 'STALE_RISK' WHEN n_events > 0 THEN 'CURRENT' ELSE 'UNKNOWN' END AS status FROM m)"""
_TICKS = """WITH t AS (SELECT date_trunc('hour', ts) AS h, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, sum(CAST(round(value * 100) AS BIGINT)) AS spent FROM events GROUP BY 1),
k AS (SELECT strftime(h, '%Y-%m-%d %H') AS tick, calls, failed, CAST(spent AS BIGINT) AS spent, CAST(sum(calls) OVER w AS BIGINT) AS total_calls, CAST(sum(failed) OVER w AS BIGINT) AS total_failed, CAST(sum(spent) OVER w AS BIGINT) AS total_spent
  FROM t WINDOW w AS (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
ORACLE_SQL = {
    "known_first_budget": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer QUALIFY c_mktsegment = 'BUILDING' OR row_number() OVER (PARTITION BY c_nationkey, c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey) <= 5",
    "merge_best_wins_coalesce": """SELECT o_custkey, max(o_totalprice) AS o_totalprice, (list(o_orderstatus ORDER BY o_totalprice DESC, o_orderkey))[1] AS o_orderstatus, (list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS o_orderkey,
bool_or(o_orderstatus = 'F') AS known, coalesce((list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0))[1], '') AS note, count(*) AS n_merged FROM orders GROUP BY o_custkey""",
    "citation_first_seen_dedup": "SELECT l_suppkey, l_partkey % 50 AS clause, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_quantity) = 1",
    "resumable_last_line": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "coverage_grid_dense": "SELECT n_nationkey, n_name, segment, count(c_custkey) AS n FROM nation CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('NONE')) AS t(segment) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = segment GROUP BY ALL",
    "gap_anti_join": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "name_gap_bidirectional": "WITH n AS (SELECT p_name AS name FROM part UNION SELECT p_type FROM part), f AS (SELECT p_name AS have FROM part WHERE p_size < 5 UNION SELECT p_type FROM part WHERE p_size = 7) SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE contains(lower(name), lower(have)) OR contains(lower(have), lower(name)))",
    "amendment_chain": f"{_CHAIN} SELECT key, year, amending_id, detected_by FROM c",
    "asof_missing_events": f"{_ASOF} SELECT key, cutoff, n_events, n_missed, missed_years, status FROM a",
    "currency_status_rollup": f"""{_ASOF}, s AS (SELECT 'e' || (key % 3) AS economy, status FROM a)
SELECT economy, status, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT economy, 'all', count(*) FROM s GROUP BY 1 UNION ALL SELECT 'all', 'all', count(*) FROM s""",
    "adjudicate_precedence": """WITH o AS (SELECT l_orderkey % 50 AS key, CAST(l_partkey % 2000 AS VARCHAR) AS section, CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'amend' ELSE 'insert' END AS op, l_orderkey || '-' || l_linenumber AS raw, l_orderkey * 10 + l_linenumber AS ord
  FROM lineitem),
c AS (SELECT c_custkey AS citation, c_custkey % 50 AS key, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE CAST(c_custkey % 2500 AS VARCHAR) END AS section, c_custkey % 2 = 0 AS commenced FROM customer),
f AS (SELECT citation, c.key, c.section, commenced, coalesce(bool_or(op = 'delete'), false) AS gone, coalesce(bool_or(op IN ('amend', 'insert')), false) AS changed,
  coalesce(string_agg(raw, '; ' ORDER BY ord, raw) FILTER (op = 'delete'), '') AS gone_text, coalesce(string_agg(raw, '; ' ORDER BY ord, raw), '') AS all_text FROM c LEFT JOIN o ON o.key = c.key AND o.section = c.section GROUP BY 1, 2, 3, 4)
SELECT citation, key, section, CASE WHEN section = '' THEN '' WHEN gone AND commenced THEN 'REPEALED' WHEN gone THEN 'STALE_RISK' WHEN changed THEN 'AMENDED' ELSE 'CURRENT' END AS status,
  md5(CASE WHEN section = '' THEN '' WHEN gone THEN gone_text WHEN changed THEN all_text ELSE '' END) AS text_md5 FROM f""",
    "or_keys_match": """WITH c AS (SELECT c_custkey AS citation, unnest(['act:' || (c_custkey % 90), 'title:' || (c_custkey % 80)]) AS key FROM customer),
e AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'act:' ELSE 'title:' END || (s_suppkey % 95) AS key, CAST(2000 + s_suppkey % 20 AS INTEGER) AS year FROM supplier)
SELECT DISTINCT citation, year, 'x' AS amending_id FROM c JOIN e USING (key)""",
    "rate_spacing_schedule": """WITH n AS (SELECT event_id, user_id, floor(epoch(ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
s AS (SELECT event_id, t, i * 3600 + max(t - i * 3600) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS starts FROM n)
SELECT event_id, CAST(starts AS DOUBLE) AS starts, CAST(starts - t AS DOUBLE) AS wait FROM s""",
    "circuit_breaker_runs": """WITH m AS (SELECT event_id, user_id, ts, CAST(event_type IN ('error', 'click') AS INTEGER) AS f FROM events),
g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT event_id, CAST(run AS BIGINT) AS run, bool_or(run >= 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM r""",
    "degrade_gate": "SELECT user_id, count(*) AS asked, count(*) FILTER (event_type IN ('error', 'click', 'view')) AS failed, count(*) FILTER (event_type IN ('error', 'click', 'view')) > CAST(0.5 AS DOUBLE) * count(*) AS degraded FROM events GROUP BY user_id",
    "stall_intervals": """WITH g AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events)
SELECT event_id, gap, gap // 1500 AS reports FROM g WHERE gap >= 1500""",
    "heartbeat_totals": f"{_TICKS} SELECT * FROM k",
    "budget_alarm": f"{_TICKS} SELECT min(tick) AS tick, min(total_spent) AS total_spent FROM k WHERE total_spent > 100000",
    "echo_fingerprints": """WITH f AS (SELECT user_id % 5 AS portal, user_id AS query, event_type AS item FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT portal, sha256(item) AS fingerprint, count(DISTINCT query) AS n_queries FROM f GROUP BY 1, 2 HAVING count(DISTINCT query) >= 3""",
    "ttl_cache_valid": "SELECT o_orderkey, o_orderkey % 5 = 0 OR 870000000 - floor(epoch(o_orderdate)) < 24 * 365 * 3600 AS valid FROM orders",
    "cache_miss_anti": "WITH d AS (SELECT doc_id, sha256('m1' || chr(0) || lang || chr(0) || text) AS key FROM documents) SELECT key, doc_id FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id % 3 = 0)",
    "cache_coverage": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, count(*) FILTER (doc_id % 3 = 0) AS live, count(*) AS total FROM documents GROUP BY 1",
    "replay_lookup": "WITH r AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 <> 0) SELECT page_id, CASE WHEN r.url IS NULL THEN 504 ELSE 200 END AS status, r.url IS NULL AS miss FROM pages LEFT JOIN r ON r.url = pages.url",
    "cost_ledger_nullable": """WITH r(model, a, b, c) AS (VALUES ('click', CAST(2 AS DOUBLE), CAST(1 AS DOUBLE), CAST(8 AS DOUBLE)), ('view', 3, 1, 4), ('error', 1, 1, 1), ('signup', 3, 1, 9)),
p AS (SELECT event_id // 5 AS run, CASE WHEN r.model IS NOT NULL THEN ((event_id % 1000 - least(event_id % 1500, event_id % 1000)) * a + least(event_id % 1500, event_id % 1000) * b + (event_id % 100) * c) / 1e6 END AS cost
  FROM events LEFT JOIN r ON r.model = event_type)
SELECT run, count(*) AS calls, CASE WHEN count(*) = count(cost) THEN round(sum(cost), 6) ELSE CAST(-1 AS DOUBLE) END AS cost, count(*) - count(cost) AS unpriced FROM p GROUP BY run""",
    "confusion_micro": """WITH b AS (SELECT coalesce(l.doc_id, d.doc_id) % 4 AS g, l.doc_id AS x, d.doc_id AS y FROM (SELECT doc_id FROM labels WHERE quality = 1) AS l FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 1500) AS d ON l.doc_id = d.doc_id),
c AS (SELECT g, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (x IS NULL) AS fp, count(*) FILTER (y IS NULL) AS fn FROM b GROUP BY g)
SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "na_violations": "SELECT t.source, count(doc_id) AS violations FROM (VALUES ('src1'), ('src3'), ('srcX')) AS t(source) LEFT JOIN (SELECT * FROM documents WHERE n_chars > 3000) AS d ON d.source = t.source GROUP BY 1",
    "multihit_groups": "SELECT l_partkey, l_linestatus, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS indicators, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) >= 2",
    "cooccurrence_pairs": "WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 12 AS i FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS n FROM s AS x JOIN s AS y ON x.l_orderkey = y.l_orderkey AND x.i < y.i GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 12",
    "interval_merge_columns": """WITH e AS (SELECT user_id % 20 AS page, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS x0 FROM events), i AS (SELECT page, x0, x0 + 1800 AS x1 FROM e),
o AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o)
SELECT page, CAST(island AS BIGINT) AS island, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM g GROUP BY 1, 2""",
    "pass_stability": "WITH s AS (SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS st FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(CAST(100 AS DOUBLE) * avg(CAST(st AS INTEGER)), 1) AS stable_pct FROM s",
    "review_agreement": "SELECT count(toxic) AS decided, count(*) FILTER (toxic = 1 - quality) AS agreed, round(CAST(count(*) FILTER (toxic = 1 - quality) AS DOUBLE) / count(toxic), 6) AS rate FROM labels",
    "tumbling_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT strftime(h, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h FROM events) GROUP BY 1",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1500 SECOND THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT n, count(*) AS sessions FROM c GROUP BY n""",
    "instruction_diff": """WITH a AS (SELECT DISTINCT l_partkey % 500 AS k, l_returnflag FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey % 500 AS k, l_returnflag FROM lineitem WHERE l_linenumber = 2)
SELECT 'both' AS side, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
}
