"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class gets a mean and a shrinkage covariance of the transformed statistics; a document's score
is the logistic of the difference of the two log densities and priors, where the Mahalanobis distances
use Cholesky factors that are factored once and enter the plan as constants. Statistics, moments and
scores are native expressions; only the moments of two classes (a few hundred numbers) reach the
driver. The query learns from all labelled rows that may be learnt from; the pipeline's stage from a bounded
number of them, FIT_ROWS.

Defined cases: a null text is an empty one, and both get a score; a null or unlabelled doc_id is scored
but never learnt from; a document with clashing labels counts with the smallest; repeated rows are
scored each for itself; with no rows of a class to learn from, every score is the share of class 1
(0.5 with no labels at all); an empty table gives an empty result. Input columns are only read by the
names given, and `score` adds none but those it states.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stage, table
from .quality_rules import SPACES, STOP_WORDS, SYMBOLS, _count

FEATURES = ("word_chars", "symbols", "marks", "capitals", "digits", "variety", "stops", "lines", "line_variety")
SHRINKAGE = 0.05  # share of the diagonal target in each covariance
FLOOR = 1e-3  # least variance of a feature
FIT_ROWS = 20_000  # labelled documents that the pipeline's stage learns from at most: a table of 300 kB


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and one double column for each of FEATURES (prefixed f_)."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = docs.select(
        *keep,
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
        F.split(t, "\n").alias("_lines"),
        F.length(F.translate(t, SPACES, "")).alias("_chars"),
        _count(t, SYMBOLS).alias("_symbols"),
        _count(t, "!?").alias("_marks"),
        _count(t, "0123456789").alias("_digits"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("_capitals"),
    ).select(
        *keep,
        F.size("_words").alias("_n"),
        F.size(F.array_distinct("_words")).alias("_kinds"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_line_kinds"),
        "_chars",
        "_symbols",
        "_marks",
        "_digits",
        "_capitals",
    )
    # shares of a short text are drawn to those of usual prose, as if it had ten more words of that
    share = lambda a, b, usual, more=10.0: (F.col(a) + F.lit(usual * more)) / (F.col(b) + F.lit(more))
    forms = {
        "word_chars": F.log(share("_chars", "_n", 5.0)),
        "symbols": F.sqrt(share("_symbols", "_n", 0.0)),
        "marks": F.sqrt(share("_marks", "_n", 0.0)),
        "capitals": F.sqrt(share("_capitals", "_chars", 0.02, 50.0)),
        "digits": F.sqrt(share("_digits", "_chars", 0.0, 50.0)),
        "variety": F.log1p("_kinds") / F.greatest(F.log1p("_n"), F.lit(0.5)),
        "stops": F.sqrt(share("_stops", "_n", 0.22)),
        "lines": F.log(share("_n", "_n_lines", 30.0, 2.0)) / 2,
        "line_variety": share("_line_kinds", "_n_lines", 1.0, 2.0),
    }
    return counts.select(*keep, *[forms[k].cast("double").alias(f"f_{k}") for k in FEATURES])


@dataclass(frozen=True)
class Gaussian:
    """A class: mean, inverse Cholesky factor of its covariance, half log determinant, log prior."""

    mean: np.ndarray
    whiten: np.ndarray
    half_log_det: float
    log_prior: float

    def log_density(self, x: list[Column]) -> Column:
        total = F.lit(self.log_prior - self.half_log_det)
        for row in range(len(self.mean)):
            z = F.lit(0.0)
            for k in range(row + 1):
                z = z + (x[k] - F.lit(float(self.mean[k]))) * F.lit(float(self.whiten[row, k]))
            total = total - 0.5 * z * z
        return total


@dataclass(frozen=True)
class Model:
    good: Gaussian | None
    bad: Gaussian | None
    prior: float

    def score(self) -> Column:
        """Of a row with the columns of `statistics`."""
        if self.good is None or self.bad is None:
            return F.lit(self.prior)
        x = [F.col(f"f_{k}") for k in FEATURES]
        gap = self.good.log_density(x) - self.bad.log_density(x)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), gap))))


def _gaussian(n: float, sums: np.ndarray, products: np.ndarray, share: float, shrinkage: float) -> Gaussian:
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    spread = np.maximum(np.diag(cov), FLOOR)
    cov = (1 - shrinkage) * cov + shrinkage * np.diag(spread)
    cov[np.diag_indices_from(cov)] += FLOOR
    factor = np.linalg.cholesky(cov)
    return Gaussian(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), math.log(share))


def fit(learn: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """From rows with the columns of `statistics` and `label` (0 or 1)."""
    p = len(FEATURES)
    x = [F.col(f"f_{k}") for k in FEATURES]
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    moments = learn.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs],
    )
    by = {r["label"]: r for r in moments.collect() if r["label"] in (0, 1)}  # two rows
    total = sum(r["n"] for r in by.values())
    prior = by[1]["n"] / total if 1 in by else (0.0 if total else 0.5)
    made: dict[int, Gaussian] = {}
    for label, r in by.items():
        products = np.zeros((p, p))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        made[label] = _gaussian(r["n"], np.array([r[f"s{i}"] for i in range(p)]), products, r["n"] / total, shrinkage)
    return Model(made.get(1), made.get(0), prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, label), one row a document, of those that may be learnt from: all, or the `most` first by a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    found = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    return found if most is None else found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stage(statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-statistics")
    model = fit(measured.join(learnable(table(spark, sf_dir, "labels")), "doc_id"))
    score = model.score()
    return measured.select("doc_id", held_out().alias("held_out"), score.cast("double").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the classifier rejects go.

    It learns from FIT_ROWS labelled documents at most, so their ids are few enough to broadcast, only their
    texts are measured twice, and no text moves. A null or empty text gets a score as any other; a null doc_id is
    scored but never learnt from; rows that repeat are judged each for itself; without labels all rows stay; an
    empty table gives an empty result; whatever columns are named, all come back, as they were.
    """
    few = F.broadcast(learnable(table(spark, sf_dir, "labels"), FIT_ROWS))
    model = fit(statistics(docs.select("doc_id", "text").join(few, "doc_id"), ["label"]))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"), F.col("text").alias("_text"))
    kept = statistics(whole, ["_document"], "_text").where(model.score() >= 0.5)
    return kept.select(*[F.col(f"_document.`{c}`").alias(c) for c in docs.columns])


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}  # a fitted model: held-out accuracy is tested
