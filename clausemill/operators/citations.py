"""From ranked clauses to citations: judges, validation, lanes, provenance."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys, scoring
from ..session import ship
from . import retrieval, rules

OCR_LEAST = 0.85
DEGRADED_FLOOR = 0.7

#: A judge takes clause texts and gives, for each, the indicators that it finds relevant, or None where it failed.
Judge = Callable[[list[str]], list[list[str] | None]]


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form with white space collapsed; what quotes are compared in."""
    for s in batches:
        yield s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def review_status(primary: Column, ocr_confidence: Column, same_text: Column, label: Column) -> Column:
    """In order of precedence; HALLUCINATED rows are not published."""
    return (
        F.when(~primary, "NO_PRIMARY_SOURCE_FOUND")
        .when(F.coalesce(ocr_confidence < OCR_LEAST, F.lit(False)), "LOW_OCR_CONFIDENCE")
        .when(~same_text, "HALLUCINATED_OR_UNSUPPORTED_MAPPING")
        .when(label == "uncertain", "CONFLICT_REVIEW")
        .otherwise("VERIFIED")
    )


def validated(claims: DataFrame) -> DataFrame:
    """Claims (with quote, span_text, primary, ocr_confidence, label) with `review_status`, unsupported ones left out.

    A quote that is the span's very text needs no normalising, so Python sees the others only.
    """
    ship(claims.sparkSession)
    exact = F.col("quote") == F.col("span_text")
    same, other = claims.where(exact), claims.where(~exact | exact.isNull())
    status = lambda ok: review_status(F.col("primary"), F.col("ocr_confidence"), ok, F.col("label"))
    done = same.withColumn("review_status", status(F.lit(True))).unionByName(
        other.withColumn("_ok", F.coalesce(nfkc("quote") == nfkc("span_text"), F.lit(False))).withColumn("review_status", status(F.col("_ok"))).drop("_ok")
    )
    return done.where(F.col("review_status") != "HALLUCINATED_OR_UNSUPPORTED_MAPPING")


def verdict_keys(clauses: DataFrame, model: str, fingerprint: str, text: str = "text") -> DataFrame:
    return clauses.withColumn("key", keys.composite_key(F.lit(model), F.lit(fingerprint), F.col(text)))


def judged(clauses: DataFrame, judge: Judge, stored: DataFrame | None, model: str, fingerprint: str, text: str = "text") -> DataFrame:
    """Clauses with `verdict` (array of indicators, null where the judge failed).

    Stored verdicts are joined by key; the judge is asked for the rest, once for each distinct text.
    """
    keyed = verdict_keys(clauses, model, fingerprint, text)
    asked = keyed.select("key", F.col(text).alias("text")).dropDuplicates(["key"])
    if stored is not None:
        asked = asked.join(stored.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "verdict": judge(b["text"].tolist())})

    ship(clauses.sparkSession)
    new = asked.mapInPandas(run, "key string, verdict array<string>")
    known = new if stored is None else stored.select("key", "verdict").unionByName(new)
    return keyed.join(known, "key", "left").drop("key")


def ranking_lane(hits: DataFrame, by: list[str], min_score: float = 0.35, rel_floor: float = 0.6, k: int = 3) -> DataFrame:
    """Citations without a judge: hits (by, score, text, ord) past the gate, the boundary rules and the floor."""
    admitted = hits.where(rules.admits(F.col("indicator"), F.col("text")) & ~rules.boilerplate(F.col("text")))
    top = retrieval.top_k(admitted, by, [F.col("score").desc(), F.col("ord")], k)
    return retrieval.above_floor(top, by, min_score, rel_floor)


def clause_lane(hits: DataFrame, verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Citations of a judge: hits (by, indicator, score) and clauses' verdicts, turned to indicator rows.

    A pair that was ranked keeps its own score; one that the judge added has the clause's best.
    """
    best = retrieval.pool(hits, by)
    said = verdicts.where("verdict is not null").select(*by, "text", F.explode("verdict").alias("indicator"))
    pairs = hits.select(*by, "indicator", F.col("score").alias("pair_score"))
    out = said.join(best, by).join(pairs, [*by, "indicator"], "left").withColumn("score", F.coalesce("pair_score", "score")).drop("pair_score")
    return out.where(rules.admits(F.col("indicator"), F.col("text"))).withColumn("confidence", scoring.normalised(F.col("score")))


def with_fallback(judged_rows: DataFrame, ranked_rows: DataFrame, degraded: DataFrame, doc: str) -> DataFrame:
    """A degraded document's citations come from the ranking lane above the degraded floor, and say so."""
    bad = degraded.where("degraded").select(doc)
    kept = judged_rows.join(bad, doc, "left_anti").withColumn("lane", F.lit("JUDGED"))
    fallen = ranked_rows.join(bad, doc, "left_semi").where(F.col("confidence") >= DEGRADED_FLOOR).withColumn("lane", F.lit("DEGRADED"))
    return kept.unionByName(fallen, allowMissingColumns=True)


def with_provenance(citations: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds `provenance`: notes of secondary sources on the indicator; they corroborate, they are no evidence."""
    notes = signals.groupBy("indicator").agg(F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("provenance"))
    return citations.join(notes, "indicator", "left")


def gaps(signals: DataFrame, citations: DataFrame) -> DataFrame:
    """Indicators that a secondary source affirms and no citation covers."""
    yes = signals.where("presence = 'yes'").select("economy", "indicator").distinct()
    return yes.join(citations.select("economy", "indicator"), ["economy", "indicator"], "left_anti")


#: Keeps or drops: takes (indicator, candidates (clause_id, text)) and gives the clause ids it keeps, or None where it failed.
Keeper = Callable[[str, list[tuple[str, str]]], list[str] | None]
#: Picks at most one: gives {clause_id, label, confidence}, or None.
Picker = Callable[[str, list[tuple[str, str]]], dict | None]
LABELS = ("match", "uncertain")


def _asked(candidates: DataFrame, by: list[str], ask: Callable, schema: str) -> DataFrame:
    """(by, answer) of each group's candidates (by, indicator, clause_id, text, rank), which retrieval bounds to a few."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "clause_id", "text")))
    groups = candidates.groupBy(*by, "indicator").agg(listed.alias("_candidates"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [_safely(ask, i, [(c["clause_id"], c["text"]) for c in cs]) for i, cs in zip(b["indicator"], b["_candidates"])]
            yield b[[*by, "indicator"]].assign(answer=pd.Series(said, index=b.index, dtype=object))

    ship(candidates.sparkSession)
    names = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in [*by, "indicator"])
    return groups.mapInPandas(run, f"{names}, answer {schema}")


def _safely(ask: Callable, *args):
    """A model that fails gives no answer; what that means is for the caller to say."""
    try:
        return ask(*args)
    except Exception:  # noqa: BLE001  a backend is somebody else's program
        return None


def kept_each(candidates: DataFrame, keeper: Keeper, by: list[str]) -> DataFrame:
    """The candidates that a judge keeps, cell by cell. It can only tighten: ids that aren't candidates count for nothing.

    An empty answer drops all; none at all, a failure, keeps all, so that an outage removes no citation.
    """
    said = _asked(candidates, by, keeper, "array<string>")
    out = candidates.join(said, [*by, "indicator"])
    return out.where(F.col("answer").isNull() | F.array_contains("answer", F.col("clause_id"))).drop("answer")


def picked(candidates: DataFrame, picker: Picker, by: list[str]) -> DataFrame:
    """At most one candidate a cell, with `label` and `confidence` (0 to 1, 0.5 where it isn't a number).

    A failure, another label or an id that isn't a candidate's picks none.
    """

    def ask(indicator: str, cs: list[tuple[str, str]]) -> dict | None:
        said = picker(indicator, cs)
        if not said:
            return None
        try:
            sure = min(1.0, max(0.0, float(said.get("confidence", 0.5))))
        except (TypeError, ValueError):
            sure = 0.5
        return {"clause_id": str(said.get("clause_id") or ""), "label": str(said.get("label", "")).lower(), "confidence": sure}

    said = _asked(candidates, by, ask, "struct<clause_id: string, label: string, confidence: double>").where(F.col("answer.label").isin(*LABELS))
    met = said.select(*by, "indicator", "answer.clause_id", "answer.label", "answer.confidence")
    return candidates.join(met, [*by, "indicator", "clause_id"])


LEAST_LAW = 400  # characters of a law's text that can be judged


def relevant(laws: DataFrame, passes: list[Judge], by: list[str], text: str = "text") -> DataFrame:
    """Laws (with `indicators`, what discovery attributed) with `subset`: the union of what passes over the whole text found.

    Too short a text, passes that all failed and an empty union keep the attribution: a judge narrows, it doesn't invent.
    """
    long = laws.where(F.length(text) >= LEAST_LAW)
    found = None
    for k, judge in enumerate(passes):
        one = judged(long.select(*by, text), _all_or_none(judge), None, f"pass {k}", "", text).select(*by, "verdict")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return laws.withColumn("subset", F.col("indicators"))
    union = found.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("verdict")))).alias("_union"))
    out = laws.join(union, by, "left")
    return out.withColumn("subset", F.when(F.size("_union") > 0, F.col("_union")).otherwise(F.col("indicators"))).drop("_union")


def _all_or_none(judge: Judge) -> Judge:
    return lambda texts: _safely(judge, texts) or [None] * len(texts)


def one_by_one(clauses: DataFrame, catalogue: DataFrame, judge: Callable[[str, list[str]], list[bool | None]], by: list[str], text: str = "text") -> DataFrame:
    """Clauses with `verdict`, from a question for each indicator instead of one for all; null as soon as one question failed."""
    asked = clauses.select(*by, F.col(text).alias("text")).join(catalogue.select("indicator", "query"), how="cross")  # a catalogue is tens of rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for query, part in b.groupby("query", sort=False):
                said = _safely(judge, query, part["text"].tolist()) or [None] * len(part)
                parts.append(part.drop(columns=["text", "query"]).assign(said=pd.Series(said, index=part.index, dtype=object)))
            if parts:
                yield pd.concat(parts)

    ship(clauses.sparkSession)
    names = ", ".join(f"`{c}` {clauses.schema[c].dataType.simpleString()}" for c in by)
    rows = asked.mapInPandas(run, f"{names}, indicator string, said boolean")
    verdict = F.when(F.every(F.col("said").isNotNull()), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("said"), F.col("indicator"))))))
    return rows.groupBy(*by).agg(verdict.alias("verdict"))


def judge_of(option: str | Judge | None) -> Judge | None:
    """A judge by option: none, "rules" (the boundary rules alone decide) or a function; one that breaks gives no verdicts, never an error."""
    if option is None or option == "none":
        return None
    if option == "rules":
        return lambda texts: [[] for _ in texts]
    if not callable(option):
        raise ValueError(f"a judge is none, rules or a function, not {option!r}")
    return _all_or_none(option)
