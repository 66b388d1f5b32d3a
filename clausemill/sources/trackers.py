"""Secondary trackers: what others say that a law exists. They corroborate and point; they are no evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = "economy string, indicator string, source string, presence string, law string, note string"
#: Builders of signals by source name; each takes (spark, options) and gives rows of SIGNAL.
REGISTRY: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def source(name: str):
    def register(build: Callable[[SparkSession, dict], DataFrame]):
        REGISTRY[name] = build
        return build

    return register


def code_map(scripts: DataFrame, columns: dict[int, tuple[str, ...]], presence: dict[int, str], name: str, text: str = "text") -> DataFrame:
    """Signals from a script that holds a map of economies to codes, one code a column."""
    found = F.regexp_extract(text, r"(?s)countries\s*[=:]\s*(\{.*?\})", 1)
    rows = scripts.select(F.explode(F.from_json(found, "map<string,array<int>>")).alias("economy", "codes"))
    said = F.create_map(*[F.lit(x) for kv in presence.items() for x in kv])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("indicator")) for c, ids in columns.items() for i in ids])
    each = rows.select("economy", "codes", F.explode(cells).alias("c")).where(F.size("codes") > F.col("c.column"))
    value = F.coalesce(F.try_element_at(said, F.get("codes", F.col("c.column"))), F.lit("unknown"))
    return each.select(
        F.upper("economy").alias("economy"), F.col("c.indicator").alias("indicator"), F.lit(name).alias("source"), value.alias("presence"), F.lit("").alias("law"),
        F.concat(F.lit(f"{name}: "), value).alias("note"),
    )


LAW = r"\b((?:[A-Z][A-Za-z'’()&-]+\s+(?:of\s+|on\s+|and\s+|for\s+|the\s+)*){1,9}(?:Act|Law|Ordinance|Regulations?|Code|Decree)(?:\s+(?:of\s+)?(?:19|20)\d{2})?)"


def named_laws(prose: DataFrame, economy: str, text: str = "text", least: int = 8) -> DataFrame:
    """(economy, law, ord): laws that prose names, each once, the first spelling kept."""
    found = prose.select(economy, F.posexplode(F.regexp_extract_all(text, F.lit(LAW), F.lit(1))).alias("ord", "law"))
    tidy = found.withColumn("law", F.trim(F.regexp_replace("law", r"^(?i:(?:the|under|in|see)\s+)+", ""))).where(F.length("law") >= least)
    return tidy.groupBy(economy, F.lower("law").alias("k")).agg(F.min(F.struct("ord", "law")).alias("b")).select(economy, "b.law", "b.ord")


def law_signals(laws: DataFrame, indicators: list[str], name: str, economy: str = "economy") -> DataFrame:
    """Every named law for each of a tracker's indicators."""
    each = F.explode(F.array(*[F.lit(i) for i in indicators])).alias("indicator")
    rows = laws.select(F.col(economy).alias("economy"), "law", each)
    return rows.select("economy", "indicator", F.lit(name).alias("source"), F.lit("yes").alias("presence"), "law", F.concat(F.lit(f"{name}: "), "law").alias("note"))


def snapshot(spark: SparkSession, values: dict[str, dict[str, float]], indicator: str, name: str) -> DataFrame:
    """Signals from a nested map of economy to measure to value: yes where a value is above zero."""
    rows = [(e.upper(), indicator, name, "yes" if v > 0 else "no", "", f"{name}: {m} = {v}") for e, by in values.items() for m, v in by.items()]
    return spark.createDataFrame(rows, SIGNAL)


def gathered(spark: SparkSession, names: list[str], options: dict) -> tuple[DataFrame, dict[str, str]]:
    """Signals of all sources, and what went wrong with those that failed; one that fails doesn't take the others along."""
    out, failed = spark.createDataFrame([], SIGNAL), {}
    for n in names:
        try:
            out = out.unionByName(REGISTRY[n](spark, options))
        except Exception as e:  # noqa: BLE001  sources are other people's pages
            failed[n] = f"{type(e).__name__}: {e}"
    return out, failed


def seeds(signals: DataFrame) -> DataFrame:
    """Names worth searching for: laws that a tracker affirms, once each whatever their case."""
    yes = signals.where("presence = 'yes' and law <> ''")
    return yes.groupBy("economy", F.lower("law").alias("k")).agg(F.min("law").alias("law")).select("economy", "law")
