"""Small catalogues: indicators, jurisdictions, gold tables, caches as tables."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDICATOR = (
    "rdtii_id string, submission_id string, pillar int, name string, description string, long_definition string, "
    "scoring_criteria string, possible_scores array<double>, keywords array<string>, discovery_queries array<string>"
)
DEFAULT_PILLARS = (6, 7)


def _squeeze(v: str | None) -> str:
    return " ".join((v or "").split())


def indicators(spark: SparkSession, path: str, pillars: tuple[int, ...] | None = DEFAULT_PILLARS) -> DataFrame:
    """A row for each indicator of the pillars (all, for None)."""
    rows = []
    for p in yaml.safe_load(Path(path).read_text(encoding="utf-8"))["pillars"]:
        if pillars is not None and int(p["pillar"]) not in pillars:
            continue
        for i in p.get("indicators") or []:
            rows.append(
                (str(i["rdtii_id"]), str(i["submission_id"]), int(p["pillar"]), _squeeze(i.get("name")), _squeeze(i.get("description")), _squeeze(i.get("long_definition")),
                 _squeeze(i.get("scoring_criteria")), [float(s) for s in i.get("possible_scores") or []], list(i.get("keywords") or []), list(i.get("discovery_queries") or []))
            )
    return spark.createDataFrame(rows, INDICATOR)


def profile(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def profiles(folder: str) -> list[dict]:
    return [profile(str(p)) for p in sorted(Path(folder).glob("*.yaml")) if not p.name.startswith("_")]


def keyword_rows(spark: SparkSession, found: list[dict]) -> DataFrame:
    """(iso, indicator, lang, phrase, ord) of profiles' keywords."""
    rows = [
        (p["iso_code"], str(i), lang, phrase, k)
        for p in found
        for i, by in (p.get("keywords_by_indicator") or {}).items()
        for lang, phrases in by.items()
        for k, phrase in enumerate(phrases)
    ]
    return spark.createDataFrame(rows, "iso string, indicator string, lang string, phrase string, ord int")


def known_instruments(spark: SparkSession, found: list[dict]) -> DataFrame:
    rows = [(p["iso_code"], k, name) for p in found for k, name in enumerate(p.get("known_instruments") or [])]
    return spark.createDataFrame(rows, "iso string, ord int, name string")


def phrase_map(keywords: DataFrame) -> DataFrame:
    """Each phrase once, with the indicators that it is asked for."""
    return keywords.groupBy("iso", "phrase").agg(F.array_sort(F.collect_set("indicator")).alias("indicators"))


def gold_sections(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a gold table with `sections` (array) and `asserted_empty` (the gold says there are none)."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("comment", "#").csv(path)
    first = raw.columns[0]
    raw = raw.withColumnRenamed(first, first.lstrip("﻿"))
    parts = F.filter(F.transform(F.split("gold_sections", ";"), F.trim), lambda s: (s != "") & (s != "N/A"))
    return raw.withColumn("asserted_empty", F.trim("gold_sections") == "N/A").withColumn("sections", parts)


def resumed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines of which the last for a key holds; broken lines are left out."""
    lines = spark.read.text(path).withColumn("_ord", F.monotonically_increasing_id())
    rows = lines.select("_ord", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    w = Window.partitionBy(f"r.{key}").orderBy(F.col("_ord").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("r.*")


def upserted(stored: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A keyed table with new rows in place of those of the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)
