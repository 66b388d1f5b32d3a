"""Queries: tokens, BM25, fusion, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import LATIN_TOKEN, tokens
from ..operators import retrieval, rules
from ..session import small

INDICATORS = (
    ("I1", "the and of the transfer with"),
    ("I2", "was is that reed and-on"),
    ("I3", "ndre thion er le la que"),
)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def indicators(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in INDICATORS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(indicator, query)")


CLAUSE = ["corpus", "doc_id", "line_no", "char_start", "char_end", "opening"]


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by CLAUSE and indicator; `opening`: a clause that states no rule. Texts stay where they are."""
    clauses = retrieval.line_clauses(read(spark, sf, "documents"), "source").withColumn("opening", rules.boilerplate(F.col("text")))
    return retrieval.bm25(clauses, indicators(spark), CLAUSE[1:]).withColumn("score", F.round("score", 6))


def _texts_of(spark: SparkSession, sf: str, few: DataFrame) -> DataFrame:
    """Adds the document's text as `whole` to the few rows that are left."""
    return few.join(read(spark, sf, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")


def quoted() -> Column:
    return F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))


def bm25_topk_clauses(spark: SparkSession, sf: str) -> DataFrame:
    usable = _scored(spark, sf).where(~F.col("opening"))
    top = retrieval.top_k(usable, ["corpus", "indicator"], [F.col("score").desc(), F.col("doc_id"), F.col("line_no")], 3)
    few = top.withColumn("norm", F.round(scoring.normalised(F.col("score")), 6)).where("norm >= 0.01")
    line = F.get(F.split("whole", "\n"), F.col("line_no"))
    return _texts_of(spark, sf, few).select(
        "corpus", "indicator", "rank", "doc_id", "line_no", "char_start", "char_end", "score", "norm", line.alias("quote"), (quoted() == line).alias("verbatim_ok")
    )


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    ts = read(spark, sf, "documents").select("source", F.explode(tokens(F.col("text"))).alias("term"))
    counts = ts.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    return retrieval.top_k(counts, ["source"], [F.col("n").desc(), F.col("term")], 10).select("source", "term", "n", "rank")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "label", scoring.l2_normalised(F.col("embedding")).alias("v"))


def _probes(v: DataFrame) -> DataFrame:
    """One concept vector for each label: that of its smallest id."""
    return v.groupBy(F.col("label").alias("concept")).agg(F.min_by("v", "vec_id").alias("q"))


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    pairs = v.crossJoin(small(_probes(v)))  # a stated query set, a vector a label, against all rows
    return pairs.select("concept", "vec_id", "label", F.round(scoring.dot(F.col("q"), F.col("v")), 6).alias("sim"))


def cosine_topk_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.top_k(_similar(spark, sf), ["concept"], [F.col("sim").desc(), F.col("vec_id")], 5).select("concept", "vec_id", "sim", "rank")


def crosswalk_top6(spark: SparkSession, sf: str) -> DataFrame:
    near = retrieval.top_k(_similar(spark, sf).where("sim >= 0.2"), ["concept"], [F.col("sim").desc(), F.col("vec_id")], 6)
    return near.groupBy("vec_id").agg(
        F.max("sim").alias("sim"), F.array_join(F.array_sort(F.collect_set(F.col("concept").cast("string"))), ",").alias("concepts")
    )


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses by BM25 and by how many of the query's terms they have, fused; BM25's best stays on top."""
    scores = _scored(spark, sf)
    group, ties = ["corpus", "indicator"], [F.col("doc_id"), F.col("line_no")]
    lexical = retrieval.top_k(scores, group, [F.col("score").desc(), *ties], 40)
    covering = retrieval.top_k(scores, group, [F.col("n_terms").desc(), *ties], 40)
    by = [*group, "doc_id", "line_no"]
    return retrieval.anchored(retrieval.fused([(lexical, 1.0), (covering, 1.0)], by), group).where("rank <= 20").select(
        *by, F.coalesce("rank_0", F.lit(0)).alias("rank_0"), F.coalesce("rank_1", F.lit(0)).alias("rank_1"), F.round("fused", 9).alias("fused"), "rank"
    )


def semantic_bonus_rerank(spark: SparkSession, sf: str) -> DataFrame:
    best = _similar(spark, sf).groupBy("vec_id", "label").agg(F.max("sim").alias("sim"))
    scored = best.withColumn("score", F.round(scoring.semantic_bonus((F.col("vec_id") % 10) / 10.0, F.col("sim")), 6))
    return retrieval.top_k(scored, ["label"], [F.col("score").desc(), F.col("vec_id")], 5).select("label", "vec_id", "score", "rank")


def mrr_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Of each concept, its nearest vector aside: the rank of the first of its own label, and how many such are among 20; counted, not ranked as a whole."""
    near = _similar(spark, sf).withColumn("at", F.struct(-F.col("sim"), "vec_id"))
    nearest = near.groupBy("concept").agg(F.min("at").alias("top"))
    own = near.where("label = concept").join(nearest, "concept").where("at <> top").groupBy("concept").agg(F.min("at").alias("own"))
    first = near.join(own, "concept").groupBy("concept").agg((1 + F.count_if(F.col("at") < F.col("own"))).alias("first"))
    among = retrieval.top_k(near, ["concept"], [F.col("at")], 20).where("label = concept and rank > 1").groupBy("concept").agg(F.count(F.lit(1)).alias("in20"))
    hits = first.join(among, "concept", "left").na.fill(0, ["in20"])
    return hits.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("first") <= 2).alias("hit1"),
        F.count_if(F.col("first") <= 4).alias("hit3"),
        F.round(F.sum(1.0 / F.col("first")) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mrr"),
        F.sum("in20").alias("in20"),
    )


def pool_floor_shutout(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.pool_floor(_scored(spark, sf), ["corpus", "doc_id", "line_no"], 0.05)


def rel_floor_gate(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("score"))
    hits = retrieval.ranked(lines, ["l_orderkey"], [F.col("score").desc(), F.col("l_linenumber")])
    return retrieval.above_floor(hits, ["l_orderkey"], 0.35, 0.6).select("l_orderkey", "l_linenumber", "rank", F.round("norm", 6).alias("norm"))


_TOKENS = f"list_transform(regexp_extract_all(text, '{LATIN_TOKEN}'), lambda x: lower(x))"
_CLAUSES = """
l AS (SELECT source AS corpus, doc_id, text AS whole, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM l),
c AS (SELECT *, char_start + length(text) AS char_end FROM o WHERE trim(text, ' ') <> '')"""
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in INDICATORS)
_BM25 = f"""WITH {_CLAUSES},
t AS (SELECT corpus, doc_id, line_no, {_TOKENS} AS ts FROM c),
z AS (SELECT corpus, count(*) AS n, avg(len(ts)) AS avgdl FROM t GROUP BY corpus),
p AS (SELECT corpus, doc_id, line_no, dl, term, count(*) AS tf FROM (SELECT corpus, doc_id, line_no, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL),
d AS (SELECT corpus, term, count(*) AS df FROM p GROUP BY ALL),
r AS (SELECT d.*, n, avgdl, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw FROM d JOIN z USING (corpus)),
m AS (SELECT corpus, avg(raw) AS mean FROM r GROUP BY corpus),
i AS (SELECT corpus, term, avgdl, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * mean ELSE raw END AS idf FROM r JOIN m USING (corpus)),
q AS (SELECT indicator, term, count(*) AS qtf FROM (SELECT indicator, unnest({_TOKENS.replace('text', 'query')}) AS term FROM (VALUES {_VALUES}) AS v(indicator, query)) GROUP BY ALL),
s AS (SELECT corpus, doc_id, line_no, indicator,
        sum(qtf * idf * CAST(tf AS DOUBLE) * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS score, count(*) AS n_terms
      FROM p JOIN i USING (corpus, term) JOIN q USING (term) GROUP BY ALL)"""
_SIM = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v AS (SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS v FROM e),
p AS (SELECT label AS concept, arg_min(v, vec_id) AS q FROM v GROUP BY label),
s AS (SELECT concept, vec_id, label, round(list_dot_product(q, v), 6) AS sim FROM v, p)"""
_HEAD = r"regexp_matches(substring(regexp_replace(ltrim(text), '^\s*\d+[A-Z]?\s*[.—\-]*\s*', ''), 1, 48), '(?i)^(?:short title|citation|commencement|interpretation|definitions?|objects?|purpose)\b')"

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk_clauses, token_stats, cosine_topk_per_label, crosswalk_top6, rrf_fusion, semantic_bonus_rerank,
        mrr_recall_at_k, pool_floor_shutout, rel_floor_gate,
    )
}
ORACLE_SQL = {
    "bm25_topk_clauses": f"""{_BM25},
h AS (SELECT corpus, doc_id, line_no, indicator, round(score, 6) AS score, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, text, whole
      FROM s JOIN c USING (corpus, doc_id, line_no) WHERE NOT {_HEAD}),
k AS (SELECT *, row_number() OVER (PARTITION BY corpus, indicator ORDER BY score DESC, doc_id, line_no) AS rank FROM h)
SELECT corpus, indicator, CAST(rank AS INTEGER) AS rank, doc_id, CAST(line_no AS INTEGER) AS line_no, char_start, char_end, score,
  round(greatest(0, least(1, tanh(score / 40))), 6) AS norm, text AS quote, substring(whole, char_start + 1, length(text)) = text AS verbatim_ok
FROM k WHERE rank <= 3 AND round(greatest(0, least(1, tanh(score / 40))), 6) >= 0.01""",
    "token_stats": f"""WITH t AS (SELECT source, unnest({_TOKENS}) AS term FROM documents), n AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL)
SELECT source, term, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS INTEGER) AS rank FROM n QUALIFY rank <= 10""",
    "cosine_topk_per_label": f"{_SIM} SELECT concept, vec_id, sim, CAST(row_number() OVER (PARTITION BY concept ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5",
    "crosswalk_top6": f"""{_SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0.2 QUALIFY rank <= 6)
SELECT vec_id, max(sim) AS sim, string_agg(DISTINCT CAST(concept AS VARCHAR), ',' ORDER BY CAST(concept AS VARCHAR)) AS concepts FROM k GROUP BY vec_id""",
    "rrf_fusion": f"""{_BM25}, a AS (SELECT corpus, indicator, doc_id, line_no, row_number() OVER (PARTITION BY corpus, indicator ORDER BY round(score, 6) DESC, doc_id, line_no) AS r FROM s QUALIFY r <= 40),
b AS (SELECT corpus, indicator, doc_id, line_no, row_number() OVER (PARTITION BY corpus, indicator ORDER BY n_terms DESC, doc_id, line_no) AS r FROM s QUALIFY r <= 40),
f AS (SELECT corpus, indicator, doc_id, line_no, a.r AS rank_0, b.r AS rank_1, coalesce(CAST(1 AS DOUBLE) / (60 + a.r), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + b.r), 0) AS fused FROM a FULL JOIN b USING (corpus, indicator, doc_id, line_no))
SELECT corpus, indicator, doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(coalesce(f.rank_0, 0) AS INTEGER) AS rank_0, CAST(coalesce(f.rank_1, 0) AS INTEGER) AS rank_1, round(f.fused, 9) AS fused,
  CAST(row_number() OVER (PARTITION BY corpus, indicator ORDER BY CASE WHEN f.rank_0 = 1 THEN 0 ELSE 1 END, f.fused DESC, f.rank_0 NULLS LAST, f.rank_1 NULLS LAST) AS INTEGER) AS rank FROM f QUALIFY rank <= 20""",
    "semantic_bonus_rerank": f"""{_SIM}, b AS (SELECT vec_id, label, max(sim) AS sim FROM s GROUP BY ALL),
c AS (SELECT label, vec_id, round(least(1, (vec_id % 10) / CAST(10 AS DOUBLE) + CAST(0.2 AS DOUBLE) * greatest(sim, 0)), 6) AS score FROM b)
SELECT label, vec_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""",
    "mrr_recall_at_k": f"""{_SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY sim DESC, vec_id) AS rank FROM s),
h AS (SELECT concept, min(rank) AS first, count(*) FILTER (rank <= 20) AS in20 FROM k WHERE label = concept AND rank > 1 GROUP BY concept)
SELECT count(*) AS n, count(*) FILTER (first <= 2) AS hit1, count(*) FILTER (first <= 4) AS hit3, round(sum(CAST(1 AS DOUBLE) / first) / greatest(count(*), 1), 6) AS mrr, CAST(sum(in20) AS BIGINT) AS in20 FROM h""",
    "pool_floor_shutout": f"""{_BM25}, h AS (SELECT *, round(greatest(0, least(1, tanh(score / 40))), 6) AS norm FROM s),
w AS (SELECT corpus, count(*) AS pairs, count(*) FILTER (norm < 0.05) AS rejected FROM h GROUP BY corpus),
x AS (SELECT corpus, count(*) AS n FROM (SELECT corpus, doc_id, line_no FROM h GROUP BY ALL HAVING max(norm) < 0.05) GROUP BY corpus)
SELECT corpus, pairs, rejected, coalesce(n, 0) AS shut_out FROM w LEFT JOIN x USING (corpus)""",
    "rel_floor_gate": """WITH h AS (SELECT l_orderkey, l_linenumber, tanh(l_extendedprice / 1000 / 40) AS norm, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / 1000 DESC, l_linenumber) AS rank FROM lineitem),
p AS (SELECT *, first_value(norm) OVER (PARTITION BY l_orderkey ORDER BY rank) AS best, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank) AS place FROM h WHERE norm >= CAST(0.35 AS DOUBLE))
SELECT l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank, round(norm, 6) AS norm FROM p WHERE place = 1 OR norm >= CAST(0.6 AS DOUBLE) * best""",
}
