"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a native expression over the whole text, so a document is judged inside the scan:
no shuffle, no state, and nothing to lose with an executor but the task at hand.

Defined cases: a null text has no words and fails the base rule, as an empty one does; a null in any
other column is passed through; repeated rows are judged alike, each for itself; an empty table gives
an empty result; input columns that clash with a measure's name are kept out of the result of
`measure` (it returns the columns asked for in `keep` and its own).
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table

#: Function words of the languages served.
STOP_WORDS = (
    "the of and to in is was that for on with as it at by be this are from or an have not "
    "le la les de des du et est un une que qui dans pour sur au avec ne pas ce en par "
    "der die das und ist von zu den mit ein eine im auf nicht dem für sich des als auch es an "
    "el los las y del que se por con una no para lo su al como más o"
).split()

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure` `fails` `bound`."""

    name: str
    measure: str
    fails: str
    bound: float


#: The production table. Ratios are per word, per letter or per line, as the measure's name says.
RULES = (
    Rule("symbols", "symbols_per_word", ">", 0.1),
    Rule("short words", "mean_word_chars", "<", 2.0),
    Rule("long words", "mean_word_chars", ">", 15.0),
    Rule("no function words", "stop_word_share", "<", 0.01),
    Rule("capitals", "capital_share", ">", 0.4),
    Rule("shouting", "marks_per_word", ">", 0.3),
    Rule("digits", "digit_share", ">", 0.3),
    Rule("repeated lines", "dup_line_share", ">", 0.6),
)

_FAILS = {"<": operator.lt, ">": operator.gt}


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are told apart by a 64-bit hash: two of a million-word text collide once in 10^7 texts.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(placed: Column) -> Column:
        twice = F.filter(
            placed,
            lambda x, i: F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False))
            | ((i > 0) & F.coalesce(F.get(placed, i - 1)["h"] == x["h"], F.lit(False))),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, repeated))

    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n < 3, 0).otherwise(let(windows, counted)).cast("long")


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` of `docs` and every measure that rules can name."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        *keep,
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        _count(t, "!?").alias("_marks"),
        _count(t, "0123456789").alias("_digits"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("_capitals"),
    )
    words, n = F.col("_words"), F.size("_words")
    counts = base.select(
        *keep,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(words, n).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        F.size("_lines").alias("_n_lines"),
        "_marks",
        "_digits",
        "_capitals",
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counts.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("_stops", "n_words").alias("stop_word_share"),
        per("_capitals", "word_chars").alias("capital_share"),
        per("_marks", "n_words").alias("marks_per_word"),
        per("_digits", "word_chars").alias("digit_share"),
        per("n_dup_lines", "_n_lines").alias("dup_line_share"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures fails, as one array expression."""
    return F.array_compact(
        F.array(*[F.when(_FAILS[r.fails](F.col(r.measure), F.lit(float(r.bound))), F.lit(r.name)) for r in rules])
    )


def judge(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`keep`, the measures, `base_failed`, `failed_rules` (array of names) and `kept`."""
    measured = measure(docs, keep, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.withColumn("base_failed", base).withColumn("failed_rules", compile_rules(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    fails = " OR ".join(f"{r.measure} {r.fails} CAST({r.bound!r} AS DOUBLE)" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i AS p, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, p FROM g QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
c AS (SELECT rid, count(DISTINCT p + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS stops,
        length(regexp_replace(t, '[^!?]+', '', 'g')) AS marks,
        length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digits,
        length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS capitals
      FROM w LEFT JOIN c USING (rid)),
q AS (SELECT *, coalesce(n_symbols / nullif(CAST(n_words AS DOUBLE), 0), 0) AS symbols_per_word,
        coalesce(word_chars / nullif(CAST(n_words AS DOUBLE), 0), 0) AS mean_word_chars,
        coalesce(stops / nullif(CAST(n_words AS DOUBLE), 0), 0) AS stop_word_share,
        coalesce(capitals / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS capital_share,
        coalesce(marks / nullif(CAST(n_words AS DOUBLE), 0), 0) AS marks_per_word,
        coalesce(digits / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS digit_share,
        coalesce(n_dup_lines / nullif(CAST(n_lines AS DOUBLE), 0), 0) AS dup_line_share,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({fails}) AS kept FROM q"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": _sql()}
