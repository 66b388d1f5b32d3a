"""Queries of what models decide, with judges that are rules, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import citations, models, retrieval
from .lanes import _by_length
from .retrieval import indicators, read
from .verbs import _documents, cite


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("indicator"), F.col("l_linenumber").cast("string").alias("clause_id"), F.col("l_linestatus").alias("text"), F.col("l_linenumber").alias("rank")
    )


def _keeps_even(indicator: str, candidates: list[tuple[str, str]]) -> list[str] | None:
    if indicator == "N":
        raise RuntimeError("no answer")
    return ["made up"] + [c for c, _ in candidates if indicator == "R" and int(c) % 2 == 0]


def cells_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Cell by cell: one indicator's judge keeps even clauses, another's none, the third's fails."""
    return citations.kept_each(_cells(spark, sf), _keeps_even, ["l_orderkey"]).select("l_orderkey", "indicator", "clause_id")


def _picks_first(indicator: str, candidates: list[tuple[str, str]]) -> dict | None:
    said = {"R": ("match", 1.7), "A": ("no_match", 0.9), "N": ("Uncertain", "high")}[indicator]
    return {"clause_id": min(c for c, _ in candidates) if len(candidates) > 1 else "made up", "label": said[0], "confidence": said[1]}


def cells_picked(spark: SparkSession, sf: str) -> DataFrame:
    """One clause a cell of several candidates; single ones are answered with an id that isn't theirs."""
    return citations.picked(_cells(spark, sf), _picks_first, ["l_orderkey"]).select("l_orderkey", "indicator", "clause_id", "label", "confidence")


def law_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """The union of two passes over whole texts, where they are long enough and found anything."""
    d = read(spark, sf, "documents").select("doc_id", "text", F.array(F.lit("all")).alias("indicators"))
    second = lambda texts: [["I9"] if len(t) % 7 == 0 else [] for t in texts]
    return citations.relevant(d, [_by_length, second], ["doc_id"]).select("doc_id", F.array_join("subset", ",").alias("subset"))


def one_by_one_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each indicator; that of one fails for every 11th length."""

    def judge(query: str, texts: list[str]) -> list[bool | None]:
        return [None if len(t) % 11 == 0 and query.startswith("was") else (len(t) + len(query)) % 3 == 0 for t in texts]

    out = citations.one_by_one(read(spark, sf, "benchmark"), indicators(spark), judge, ["item_id"])
    return out.select("item_id", F.coalesce(F.array_join("verdict", ","), F.lit("failed")).alias("verdict"))


def stored_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of an earlier run, by key; the judge is asked for the texts that have none."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    held = citations.verdict_keys(d.where("doc_id % 3 = 0"), "m", "f").select("key").distinct().withColumn("verdict", F.array(F.lit("held")))
    return citations.judged(d, _by_length, held, "m", "f").select("doc_id", F.coalesce(F.array_join("verdict", ","), F.lit("failed")).alias("verdict"))


def provenance_notes(spark: SparkSession, sf: str) -> DataFrame:
    cited = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("indicator"))
    kinds = F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("other"))
    signals = read(spark, sf, "supplier").select(F.get(kinds, (F.col("s_suppkey") % 3).cast("int")).alias("indicator"), F.concat(F.lit("n"), (F.col("s_suppkey") % 5).cast("string")).alias("note"))
    return citations.with_provenance(cited, signals).select("c_custkey", "indicator", F.coalesce("provenance", F.lit("")).alias("provenance"))


def degraded_lane(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents: judged where the judge answered for most clauses, ranked above the floor elsewhere."""
    x = read(spark, sf, "lineitem")
    rows = x.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("indicator"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), "l_linenumber")
    degraded = x.groupBy(F.col("l_orderkey").alias("doc")).agg((F.count_if(F.col("l_linestatus") == "F") > 0.5 * F.count(F.lit(1))).alias("degraded"))
    out = citations.with_fallback(rows.where("l_linenumber <= 2"), rows.where("l_linenumber > 1"), degraded, "doc")
    return out.select("doc", "indicator", "l_linenumber", "lane")


def reranked_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Five of each nation's customers: the six best by balance, read again by a scorer of names, both rankings fused."""
    c = read(spark, sf, "customer").select("c_nationkey", F.lit("q").alias("query"), F.col("c_name").alias("text"), F.col("c_acctbal").alias("score"), "c_custkey")
    scorer = lambda: lambda query, texts: [float(int(t[-3:]) * 7 % 101) for t in texts]
    out = retrieval.reranked(c, scorer, ["c_nationkey"], [F.col("c_custkey")], 5, 6)
    return out.select("c_nationkey", "c_custkey", "score", "rank_0", "rank_1", "rank")


def encoded_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Items by hashed words: each is nearest to itself."""
    v = retrieval.encoded(read(spark, sf, "benchmark").select("item_id", "text"), retrieval.hashed_words)
    return v.select("item_id", F.round(scoring.dot(F.col("vector"), F.col("vector")), 4).alias("length"), F.size("vector").alias("n"))


def map_judged(spark: SparkSession, sf: str) -> DataFrame:
    """The map with a judge that fails on some clauses: judged documents, and those that fell back."""
    cited = cite(_documents(spark, sf), indicators(spark), _by_length, 3, 0.01, 0.6)
    return cited.groupBy("economy", "lane").agg(F.count(F.lit(1)).alias("n"))


def _answers(system: str, user: str, attempt: models.Attempt) -> tuple[str, int, int, int]:
    """Fails first, then talks, then gives an object, by the item's number; never answers every seventh."""
    n = int(user.split()[-1])
    if n % 7 == 0:
        raise models.ReplayMiss
    if attempt.json_mode and n % 2 == 0:
        raise TimeoutError
    if n % 3 == 0 and attempt.temperature < 0.2:
        return "let me think", 10, 5, 1
    return f'so ```json\n{{"n": {n}}}\n```', 10, 5, 2


def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("user"))
    out = models.asked(p, lambda: _answers, "a system")
    return out.select(F.col("key").cast("long").alias("key"), F.coalesce(F.get_json_object("content", "$.n"), F.lit("")).alias("n"), "attempts", "prompt_tokens", F.coalesce("error", F.lit("")).alias("error"))


def model_accounts(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("user"))
    answers = models.asked(p, lambda: _answers, "a system").withColumn("model", F.when(F.col("key").cast("long") % 2 == 0, "m0").otherwise("m1"))
    return models.accounts(answers, ["model"])


_ALL = (model_answers, model_accounts, cells_kept, cells_picked, law_subsets, one_by_one_verdicts, stored_verdicts, provenance_notes, degraded_lane, reranked_pool, encoded_neighbours, map_judged)
QUERIES = {f.__name__: f for f in _ALL}
_VERDICT = "concat_ws(',', CASE WHEN length(text) % 3 = 0 THEN 'I1' END, CASE WHEN length(text) % 4 = 0 THEN 'I2' END, CASE WHEN length(text) % 5 = 0 THEN 'I3' END"
_TRIED = """WITH a AS (SELECT {0} AS key, CASE WHEN {0} % 7 = 0 THEN 1 WHEN {0} % 3 = 0 THEN 3 WHEN {0} % 2 = 0 THEN 2 ELSE 1 END AS attempts FROM {1}),
t AS (SELECT *, CASE WHEN key % 7 = 0 THEN 0 WHEN key % 2 = 0 THEN attempts - 1 ELSE attempts END AS told FROM a)"""
ORACLE_SQL = {
    "model_answers": _TRIED.format("item_id", "benchmark") + " SELECT key, CASE WHEN key % 7 = 0 THEN '' ELSE CAST(key AS VARCHAR) END AS n, CAST(attempts AS INTEGER) AS attempts, CAST(10 * told AS BIGINT) AS prompt_tokens, CASE WHEN key % 7 = 0 THEN 'ReplayMiss' ELSE '' END AS error FROM t",
    "model_accounts": _TRIED.format("doc_id", "documents") + """ SELECT CASE WHEN key % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, count(*) AS calls, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(10 * told) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN key % 7 = 0 THEN 0 ELSE told + 1 END) AS BIGINT) AS completion_tokens, CAST(0.5 AS DOUBLE) AS cached_share, count(*) FILTER (key % 7 = 0) AS failed FROM t GROUP BY 1""",
    "cells_kept": "SELECT l_orderkey, l_returnflag AS indicator, CAST(l_linenumber AS VARCHAR) AS clause_id FROM lineitem WHERE l_returnflag = 'N' OR (l_returnflag = 'R' AND l_linenumber % 2 = 0)",
    "cells_picked": """WITH g AS (SELECT l_orderkey, l_returnflag AS indicator, min(CAST(l_linenumber AS VARCHAR)) AS c FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, l_returnflag AS indicator, c AS clause_id, CASE l_returnflag WHEN 'R' THEN 'match' ELSE 'uncertain' END AS label, CASE l_returnflag WHEN 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence
FROM lineitem JOIN g USING (l_orderkey) WHERE l_returnflag = indicator AND CAST(l_linenumber AS VARCHAR) = c""",
    "law_subsets": f"""WITH v AS (SELECT doc_id, CASE WHEN length(text) < 400 THEN '' ELSE CASE WHEN length(text) % 13 = 0 THEN concat_ws(',', CASE WHEN length(text) % 7 = 0 THEN 'I9' END) ELSE {_VERDICT}, CASE WHEN length(text) % 7 = 0 THEN 'I9' END) END END AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN 'all' ELSE s END AS subset FROM v""",
    "one_by_one_verdicts": """WITH b AS (SELECT item_id, length(text) AS n FROM benchmark)
SELECT item_id, CASE WHEN n % 11 = 0 THEN 'failed' ELSE concat_ws(',', CASE WHEN (n + 28) % 3 = 0 THEN 'I1' END, CASE WHEN (n + 23) % 3 = 0 THEN 'I2' END, CASE WHEN (n + 23) % 3 = 0 THEN 'I3' END) END AS verdict FROM b""",
    "stored_verdicts": f"""SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) THEN 'held' WHEN length(text) % 13 = 0 THEN 'failed' ELSE {_VERDICT}) END AS verdict FROM documents""",
    "provenance_notes": """WITH s AS (SELECT ['BUILDING', 'MACHINERY', 'other'][s_suppkey % 3 + 1] AS indicator, string_agg(DISTINCT 'n' || (s_suppkey % 5), '; ' ORDER BY 'n' || (s_suppkey % 5)) AS provenance FROM supplier GROUP BY 1)
SELECT c_custkey, c_mktsegment AS indicator, coalesce(provenance, '') AS provenance FROM customer LEFT JOIN s ON indicator = c_mktsegment""",
    "degraded_lane": """WITH d AS (SELECT l_orderkey AS doc, count(*) FILTER (l_linestatus = 'F') > CAST(0.5 AS DOUBLE) * count(*) AS bad FROM lineitem GROUP BY 1)
SELECT doc, l_returnflag AS indicator, l_linenumber, 'JUDGED' AS lane FROM lineitem JOIN d ON doc = l_orderkey WHERE NOT bad AND l_linenumber <= 2
UNION ALL SELECT doc, l_returnflag, l_linenumber, 'DEGRADED' FROM lineitem JOIN d ON doc = l_orderkey WHERE bad AND l_linenumber > 1 AND round(l_discount * 10, 2) >= CAST(0.7 AS DOUBLE)""",
    "reranked_pool": """WITH a AS (SELECT c_nationkey, c_custkey, c_acctbal AS score, CAST(right(c_name, 3) AS INTEGER) * 7 % 101 AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r0 FROM customer QUALIFY r0 <= 6),
b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY s DESC, r0) AS r1 FROM a)
SELECT c_nationkey, c_custkey, score, CAST(r0 AS INTEGER) AS rank_0, CAST(r1 AS INTEGER) AS rank_1, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(1 AS DOUBLE) / (60 + r0) + CAST(1 AS DOUBLE) / (60 + r1) DESC, r0) AS INTEGER) AS rank FROM b QUALIFY rank <= 5""",
    "encoded_neighbours": "SELECT item_id, CAST(1 AS DOUBLE) AS length, 512 AS n FROM benchmark",
}
