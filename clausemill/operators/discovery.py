"""Names to identities: known instruments, native ids, attribution, portals' budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import token_set_ratio_of
from ..functions.text import link_tokens, years
from ..session import ship
from . import merge, rules

KNOWN_LEAST, NEW_BELOW = 80.0, 55.0


def _name(title: Column) -> Column:
    return F.array_join(link_tokens(title), " ")


NAMES_MOST = 2000  # names that a task compares at a time
Named = tuple[int, str, str, frozenset[int]]  # ord, name, its tokens joined, its years


class Names:
    """Names to compare titles with, by token-set ratio.

    Two names that share no token can be no more alike than their characters allow, whatever their order: that bound is
    found for all names at once, and what it rules out isn't compared.
    """

    def __init__(self, rows: list[Named]) -> None:
        self.rows = rows
        self.tokens = [set(n.split()) for _, _, n, _ in rows]
        self.letters = {c: i for i, c in enumerate(sorted({c for _, _, n, _ in rows for c in n}))}
        self.counts = np.array([self._count(n) for _, _, n, _ in rows], dtype=np.int32).reshape(len(rows), -1)
        self.lengths = np.array([len(n) for _, _, n, _ in rows])

    def _count(self, name: str) -> np.ndarray:
        out = np.zeros(len(self.letters) + 1, dtype=np.int32)
        for c in name:
            out[self.letters.get(c, -1)] += c in self.letters
        return out

    def rated(self, title: str, years: frozenset[int], least: float) -> Iterator[tuple[float, int, str]]:
        """(ratio, ord, name) of names whose ratio may reach `least`, without those whose years differ."""
        own = set(title.split())
        bound = 200.0 * np.minimum(self.counts, self._count(title)).sum(1) / np.maximum(self.lengths + len(title), 1)
        for i, (ord_, name, joined, named) in enumerate(self.rows):
            if (bound[i] >= least or own & self.tokens[i]) and not (years and named and not years & named):
                yield token_set_ratio_of(title, joined), ord_, name


def _against(titles: DataFrame, names: DataFrame, pick: Callable[[Names, str, frozenset[int]], list[tuple[float, int, str]]]) -> DataFrame:
    """(title, ratio, ord, name): for each of the distinct `titles` (title), what `pick` takes of `names` (ord, name).

    Names are a catalogue: they go to the tasks, in blocks of NAMES_MOST, and no title is moved for them.
    """
    spark = titles.sparkSession
    distinct = titles.select("title").distinct().select("title", _name(F.col("title")).alias("n"), years(F.col("title")).alias("y"))
    rows = names.select("ord", "name", _name(F.col("name")).alias("n"), years(F.col("name")).alias("y")).orderBy("ord").toLocalIterator()
    out = None
    for block in iter(lambda: [(r["ord"], r["name"], r["n"], frozenset(r["y"])) for r in islice(rows, NAMES_MOST)], []):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = Names(shared.value)
            for b in batches:
                found = [(t, *x) for t, n, y in zip(b["title"], b["n"], b["y"]) for x in pick(known, n or "", frozenset(y) if y is not None else frozenset())]
                yield pd.DataFrame(found, columns=["title", "ratio", "ord", "name"])

        ship(spark)
        made = distinct.mapInPandas(run, "title string, ratio double, ord long, name string")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else spark.createDataFrame([], "title string, ratio double, ord long, name string")


def _nearest(known: Names, title: str, own: frozenset[int]) -> list[tuple[float, int, str]]:
    return sorted(known.rated(title, own, 1e-9), key=lambda x: (-x[0], x[1]))[:1]


def tagged(candidates: DataFrame, known: DataFrame, id_col: str = "id", title: str = "title") -> DataFrame:
    """Candidates with `ratio`, `matched` and `tag` (KNOWN, NEW or null) by their best known name (ord, name).

    Each distinct title is compared with all known names. Of equal ratios the first known name wins; names whose years
    differ never match.
    """
    rated = _against(candidates.select(F.col(title).alias("title")), known, _nearest)
    best = rated.groupBy("title").agg(F.max_by(F.struct("ratio", "name"), F.struct("ratio", -F.col("ord"))).alias("b")).withColumnRenamed("title", "_title")
    out = candidates.join(best, F.col(title).eqNullSafe(F.col("_title")), "left").withColumn("ratio", F.coalesce("b.ratio", F.lit(0.0)))
    tag = F.when(F.col("ratio") >= KNOWN_LEAST, "KNOWN").when(F.col("ratio") < NEW_BELOW, "NEW")
    return out.withColumn("tag", tag).withColumn("matched", F.when(F.col("ratio") >= KNOWN_LEAST, F.col("b.name"))).drop("b", "_title")


def attributed(hits: DataFrame, hints: DataFrame, id_col: str = "id", title: str = "title", least: float = KNOWN_LEAST) -> DataFrame:
    """Hits with `indicators`: those one of whose name hints (indicator, phrase) is in the title, or nearly; empty where none is.

    A hint with another year than the title hints all the same: it names a kind of law.
    """
    names = hints.select(F.xxhash64("phrase").alias("ord"), F.col("phrase").alias("name")).distinct()

    def near(known: Names, t: str, _: frozenset[int]) -> list[tuple[float, int, str]]:
        return [x for x in known.rated(t, frozenset(), least) if x[0] >= least]

    met = _against(hits.select(F.col(title).alias("title")), names, near).join(hints.withColumnRenamed("phrase", "name"), "name")
    found = met.groupBy(F.col("title").alias("_title")).agg(F.array_sort(F.collect_set("indicator")).alias("indicators"))
    out = hits.join(found, F.col(title) == F.col("_title"), "left").drop("_title")
    return out.withColumn("indicators", F.coalesce("indicators", F.array().cast("array<string>")))


def identified(candidates: DataFrame, ids: DataFrame, ident: str) -> DataFrame:
    """An instrument's native id decides before its name does."""
    named = ids.select(ident, F.col("name").alias("_name"))
    out = candidates.join(named, ident, "left")
    known = F.col("_name").isNotNull()
    return out.withColumn("tag", F.when(known, "KNOWN").otherwise(F.col("tag"))).withColumn("matched", F.coalesce("_name", "matched")).drop("_name")


def inventory(feeds: DataFrame, repeals: DataFrame) -> DataFrame:
    """Feeds (act_no, feed_ord, title, malay, commencement, pdf) merged by number, with what repealed them."""
    first = lambda c: F.min_by(F.col(c), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col("feed_ord")))
    merged = feeds.groupBy("act_no").agg(
        F.min_by("title", F.struct("malay", "feed_ord")).alias("title"), first("commencement").alias("commencement"), first("pdf").alias("pdf"),
        F.array_sort(F.collect_set("feed_ord")).alias("feeds"),
    )
    out = merged.join(repeals.select("act_no", "repealed_by"), "act_no", "full")
    return out.withColumn("repealed", F.col("repealed_by").isNotNull()).withColumn("in_force", F.col("repealed_by").isNull() & (F.coalesce("commencement", F.lit("")) != ""))


def backstop(known: DataFrame, stock: DataFrame, found: DataFrame) -> DataFrame:
    """Known numbers that the inventory can serve and no search has found."""
    served = known.select("act_no").distinct().join(stock.where("pdf is not null and pdf <> ''"), "act_no")
    return served.join(found.select("act_no"), "act_no", "left_anti").withColumn("score", F.lit(1.0)).withColumn("tag", F.lit("KNOWN"))


def resolved_fulltext(explicit: Column, url: Column, is_pdf: Column, resolver: Column, page_pdf: Column) -> Column:
    return F.coalesce(explicit, F.when(is_pdf, url), resolver, page_pdf)


def query_floors(asked: DataFrame, query: str, floor: str) -> DataFrame:
    """A query's floor: none if any asker has none, else the least."""
    return asked.groupBy(query).agg(F.when(F.bool_or(F.col(floor).isNull()), F.lit(None)).otherwise(F.min(floor)).alias(floor))


def discovered(links: DataFrame, known: DataFrame, phrases: DataFrame, budget: int) -> DataFrame:
    """From a portal's links (query, url, title, score, is_pdf, ord) to instruments, by canonical address.

    Furniture of portals and addresses that aren't of the web go; what one address was found under is merged, and its
    phrases (query, indicator) say which indicators surfaced it; names tell KNOWN from NEW; all KNOWN stay and the best
    `budget` of the others.
    """
    usable = links.where(rules.web_address(F.col("url")) & ~rules.chrome(F.col("url"), F.col("title")) & ~rules.navigation_label(F.col("title")))
    tags = tagged(usable.select("title").distinct().withColumn("id", F.lit(0)), known).select("title", "tag", "matched")
    named = usable.join(tags, "title")
    found = merge.harvested(named)
    asked = named.select(merge.keys.canonical_url(F.col("url")).alias("key"), "query").distinct().join(phrases, "query")
    surfaced = asked.groupBy("key").agg(F.array_sort(F.collect_set("indicator")).alias("indicators"))
    out = found.join(surfaced, "key", "left").withColumn("indicators", F.coalesce("indicators", F.array().cast("array<string>")))
    return merge.known_first(out, F.col("tag") == "KNOWN", [], [F.col("score").desc(), F.col("key")], budget)


def follow_on(main: DataFrame, passes: list[tuple[str, DataFrame]], floors: DataFrame | None = None) -> DataFrame:
    """The main pass and those that follow it (amendments, child regulations, regulators' instruments), each address once.

    Rows are (key, title, year, query); a later pass adds what no earlier one has, and `found_in` says which did. Where
    `floors` (query, floor) are given, a candidate no younger than its query's floor is left out.
    """
    every = main.select("key", "title", "year", "query").withColumn("found_in", F.lit("main")).withColumn("_pass", F.lit(0))
    for i, (name, rows) in enumerate(passes, 1):
        every = every.unionByName(rows.select("key", "title", "year", "query").withColumn("found_in", F.lit(name)).withColumn("_pass", F.lit(i)))
    if floors is not None:
        every = every.join(floors, "query", "left").where((F.col("_pass") == 0) | rules.after_floor(F.col("year"), F.col("floor"))).drop("floor")
    first = every.groupBy("key").agg(F.min(F.struct("_pass", "title", "year", "query", "found_in")).alias("r"))
    return first.select("key", "r.title", "r.year", "r.query", "r.found_in")


def enumerated(stock: DataFrame, verdicts: DataFrame, framework: tuple[str, ...]) -> DataFrame:
    """A register's titles judged in two stages: (act_no, title, indicators, stage, keep).

    `stock` is (act_no, title), `verdicts` (act_no, stage, hits array) of the stages that have run: by title (1), and by contents
    (2), which is asked only where the title spoke of horizontal duties alone. Contents overrule the title, even with
    nothing; a title without verdict is pending.
    """
    by = lambda k, name: verdicts.where(F.col("stage") == k).groupBy("act_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias(name))
    met = stock.join(by(1, "_title"), "act_no", "left").join(by(2, "_contents"), "act_no", "left")
    second = rules.horizontal_only(F.col("_title"), framework)
    contents = F.when(second, F.col("_contents"))
    stage = F.when(F.col("_title").isNull(), "pending").when(second & F.col("_contents").isNull(), "second").otherwise("done")
    hits = F.coalesce(contents, F.col("_title"), F.array().cast("array<string>"))
    return met.select(*stock.columns, hits.alias("indicators"), stage.alias("stage"), (F.size(hits) > 0).alias("keep"))
