"""Ranking clauses for indicators: BM25, dense, fusion, top-k, floors.

BM25 is a token equi-join and sums: clauses that share no term with a query are never paired with it.
Query terms are a small dimension (a catalogue has tens of indicators) and Spark broadcasts it by size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import normalised
from ..functions.text import tokens
from ..session import ship, stage

K1, B, EPSILON = 1.5, 0.75, 0.25


BLOCK = 256  # lines that are summed together


def _before(lengths: Column) -> Column:
    """The sum of all before, for each of a short array."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )


def line_starts(lines: Column) -> Column:
    """Where each line begins in the text; sums in a block, then of blocks, as appending to one array of all lines would copy it for each."""
    lengths = F.transform(lines, lambda x: F.length(x) + 1)
    last = F.floor((F.size(lines) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    return F.flatten(F.zip_with(blocks, _before(sums), lambda b, at: F.transform(_before(b), lambda x: x + at)))


def line_clauses(docs: DataFrame, corpus: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with a character other than a space, as clauses with offsets into the text."""
    lines = docs.select(F.col(corpus).alias("corpus"), F.col(doc).alias("doc_id"), F.split(text, "\n").alias("lines"))
    placed = F.zip_with("lines", line_starts(F.col("lines")), lambda x, at: F.struct(x.alias("line"), at.alias("start")))
    out = lines.select("corpus", "doc_id", F.posexplode(placed).alias("line_no", "p"))
    out = out.where(F.trim(F.col("p.line")) != "")
    return out.select(
        "corpus", "doc_id", "line_no", F.col("p.start").alias("char_start"), (F.col("p.start") + F.length("p.line")).alias("char_end"), F.col("p.line").alias("text")
    )


def bm25(clauses: DataFrame, queries: DataFrame, clause_keys: list[str], text: str = "text") -> DataFrame:
    """Scores (corpus, *clause_keys, indicator, score, n_terms: of the query, that the clause has) of clauses that share a term with a query.

    `clauses` has `corpus`, the keys and the text; `queries` has `indicator` and `query`. Each corpus has
    its own counts. Terms in more than half of a corpus get EPSILON of the corpus' mean idf, the mean
    being over all its terms.
    """
    words = clauses.select("corpus", *clause_keys, tokens(F.col(text)).alias("ts"))
    # one pass counts all: a row for each distinct term of a clause, and under the empty term one with its length;
    # these are summed where they lie, so what moves is a row a term, and the vocabulary is written once for its three uses
    counted = words.select("corpus", F.size("ts").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("ts"))).alias("term"))
    counted = counted.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("length"))
    counted = stage(counted, "bm25-terms")
    sizes = counted.where("term = ''").select("corpus", F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    asked = queries.select("indicator", F.explode(tokens(F.col("query"))).alias("term")).groupBy("indicator", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select("term").distinct()
    per_clause = (
        words.select("corpus", *clause_keys, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("corpus", *clause_keys, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    raw = counted.where("term <> ''").join(sizes, "corpus").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("corpus").agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(wanted, "term", "left_semi").join(mean, "corpus").select(
        "corpus", "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf")
    )
    tf = F.col("tf").cast("double")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        per_clause.join(idf, ["corpus", "term"])
        .join(asked, "term")
        .groupBy("corpus", *clause_keys, "indicator")
        .agg(F.sum(part).alias("score"), F.count(F.lit(1)).cast("int").alias("n_terms"))
    )


def ranked(scores: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(scores: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return ranked(scores, by, order).where(F.col("rank") <= k)


def fused(rankings: list[tuple[DataFrame, float]], by: list[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (by, `rank`): sum of weight / (k + rank), and each rank."""
    out = None
    for i, (r, w) in enumerate(rankings):
        part = r.select(*by, F.col("rank").alias(f"rank_{i}"), (F.lit(float(w)) / (k + F.col("rank"))).alias(f"part_{i}"))
        out = part if out is None else out.join(part, by, "full")
    total = sum((F.coalesce(f"part_{i}", F.lit(0.0)) for i in range(len(rankings))), F.lit(0.0))
    return out.select(*by, *[f"rank_{i}" for i in range(len(rankings))], total.alias("fused"))


def anchored(fusion: DataFrame, by: list[str]) -> DataFrame:
    """Order of a fusion with the first ranking's best pinned to the top."""
    order = [
        F.when(F.col("rank_0") == 1, 0).otherwise(1),
        F.col("fused").desc(),
        F.col("rank_0").asc_nulls_last(),
        F.col("rank_1").asc_nulls_last(),
    ]
    return ranked(fusion, by, order)


def above_floor(hits: DataFrame, by: list[str], min_score: float, rel_floor: float) -> DataFrame:
    """Hits whose normalised score passes the gate and is near enough to that of the best rank."""
    passed = hits.withColumn("norm", normalised(F.col("score"))).where(F.col("norm") >= min_score)
    w = Window.partitionBy(*by).orderBy("rank")
    placed = passed.withColumn("best", F.first("norm").over(w)).withColumn("place", F.row_number().over(w))
    return placed.where((F.col("place") == 1) | (F.col("norm") >= rel_floor * F.col("best"))).drop("best", "place")


def pool(hits: DataFrame, by: list[str]) -> DataFrame:
    """Every clause that any indicator ranked, with its best score."""
    return hits.groupBy(*by).agg(F.max("score").alias("score"))


def pool_floor(hits: DataFrame, by: list[str], floor: float) -> DataFrame:
    """What a floor on the pool's normalised scores costs each corpus: pairs, those rejected, and clauses that no indicator keeps (`shut_out`).

    `hits` has corpus, the other columns of `by`, which name a clause, and `score`; a clause's best score decides it, so it is met once.
    """
    norm = F.round(normalised(F.col("score")), 6)
    clauses = hits.withColumn("norm", norm).groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("norm") < floor).alias("rejected"), F.max("norm").alias("best"))
    return clauses.groupBy("corpus").agg(F.sum("pairs").alias("pairs"), F.sum("rejected").alias("rejected"), F.count_if(F.col("best") < floor).alias("shut_out"))


#: Scores texts for a query, the better the higher.
Scorer = Callable[[str, list[str]], list[float]]
#: Turns texts into vectors of one length.
Encoder = Callable[[list[str]], list[list[float]]]
_held: dict[str, object] = {}


def once(name: str, make: Callable[[], object]) -> object:
    """What `make` gives, made once in a Python process: for models, which are slow to load."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def reranked(hits: DataFrame, scorer: Callable[[], Scorer], by: list[str], order: list[str], top: int, pool: int = 20, blend: bool = True) -> DataFrame:
    """The best `top` of hits (by, query, text, score) by a scorer that reads query and text together.

    Its pool is the max(pool, top) best by `score`, so that it never gives fewer than asked for; `blend` fuses its ranking with the
    one by score; `score` stays what it was, for the gates that follow.
    """
    first = top_k(hits, by, [F.col("score").desc(), *order], max(pool, top)).withColumnRenamed("rank", "rank_0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for b in batches:
            out = pd.Series(0.0, index=b.index)
            for query, part in b.groupby("query", sort=False):
                out[part.index] = score(query, part["text"].tolist())
            yield b.assign(_second=out)

    ship(hits.sparkSession)
    scored = first.mapInPandas(run, T.StructType([*first.schema.fields, T.StructField("_second", T.DoubleType())]))
    second = ranked(scored, by, [F.col("_second").desc(), F.col("rank_0")], "rank_1")
    fusion = 1.0 / (60 + F.col("rank_0")) + 1.0 / (60 + F.col("rank_1"))
    final = [fusion.desc(), F.col("rank_0")] if blend else [F.col("rank_1")]
    return top_k(second, by, final, top).drop("_second")


def encoded(texts: DataFrame, encoder: Callable[[], Encoder], text: str = "text", into: str = "vector") -> DataFrame:
    """`texts` with a vector of length one for each text (zeros for an empty one); the encoder is built once in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            v = np.asarray(encode([t or "" for t in b[text]]), dtype=np.float32).reshape(len(b), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield b.assign(**{into: list(v)})

    ship(texts.sparkSession)
    return texts.mapInPandas(run, T.StructType([*texts.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))]))


def hashed_words(n: int = 512) -> Encoder:
    """An encoder without a model: words counted by hash."""

    def encode(batch: list[str]) -> list[list[float]]:
        out = np.zeros((len(batch), n))
        for row, t in zip(out, batch):
            for w in re.findall("[a-z0-9]+", t.lower()):
                row[zlib.crc32(w.encode()) % n] += 1
        return out.tolist()

    return encode
