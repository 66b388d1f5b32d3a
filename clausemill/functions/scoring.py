"""Scores: BM25's scale, links, portals, costs, similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalised(score: Column, scale: float = 40.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.tanh(score / scale)))


def link_score(relevance: Column, is_pdf: Column, instrument_like: Column, has_year: Column) -> Column:
    bonus = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(F.lit(1.0), 0.75 * relevance + bonus(is_pdf, 0.15) + bonus(instrument_like, 0.10) + bonus(has_year, 0.05))


def register_score(relevance: Column, principal: Column, in_force: Column) -> Column:
    return 0.8 * relevance + F.when(principal, 0.1).otherwise(0.0) + F.when(in_force, 0.1).otherwise(0.0)


def search_score(engine: Column, lexical: Column, principal: Column) -> Column:
    return 0.4 * engine + 0.4 * lexical + F.when(principal, 0.2).otherwise(0.0)


def semantic_bonus(score: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), score + 0.2 * F.greatest(similarity, F.lit(0.0)))


def overlap(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's tokens that are among `tokens`."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query_tokens, tokens)).cast("double"), F.size(query_tokens)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.nullif(length, F.lit(0.0)))


def cost(prompt: Column, cached: Column, completion: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    """Null where a rate is unknown; cached tokens are at most the prompt's."""
    hit = F.greatest(F.lit(0), F.least(cached, prompt))
    return ((prompt - hit) * rate_in + hit * rate_cached + completion * rate_out) / 1e6


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def _indel(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every  # a zero for each character of the longest common subsequence so far
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & every
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio_of(a: str, b: str) -> float:
    """Similarity of two names by their token sets, 0 to 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    more_a, more_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not more_a or not more_b):
        return 100.0
    with_a, with_b = f"{both} {more_a}".strip(), f"{both} {more_b}".strip()
    best = _indel(with_a, with_b)
    if both:
        best = max(best, _indel(both, with_a), _indel(both, with_b))
    return best


@F.pandas_udf(T.DoubleType())
def token_set_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from clausemill.functions.scoring import token_set_ratio_of as ratio

    for a, b in batches:
        yield pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
