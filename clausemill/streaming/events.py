"""Telemetry as streams: windows, late rows, repeats, and per-host spacing as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def read_events(spark: SparkSession, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A stream of a folder's files; times without a zone are taken in the session's."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    plain = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return found.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else found


def tumbling(events: DataFrame, size: str, late: str, by: list[str], t: str = "ts") -> DataFrame:
    return events.withWatermark(t, late).groupBy(F.window(t, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, size: str, step: str, late: str, t: str = "ts") -> DataFrame:
    return events.withWatermark(t, late).groupBy(F.window(t, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str, by: list[str], t: str = "ts") -> DataFrame:
    return events.withWatermark(t, late).groupBy(F.session_window(t, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, key: list[str], late: str, t: str = "ts") -> DataFrame:
    return events.withWatermark(t, late).dropDuplicatesWithinWatermark(key)


def enriched(events: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """A stream with a static dimension."""
    return events.join(dim, key, "left")


def outcomes(events: DataFrame, outcome: str) -> DataFrame:
    """A running tally, for update mode."""
    return events.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def spaced(events: DataFrame, host: str, t: str, ident: str, interval: float) -> DataFrame:
    """When each request may start, `interval` seconds after the host's one before; the last start is the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "ident"])
        starts = []
        for at in rows["t"]:
            last = at if last is None else max(at, last + interval)
            starts.append(last)
        state.update((float(last),))
        yield pd.DataFrame({"host": [str(key[0])] * len(rows), "ident": rows["ident"].to_numpy(), "starts": starts})

    ship(events.sparkSession)
    flat = events.select(F.col(host).cast("string").alias("host"), F.unix_timestamp(t).cast("double").alias("t"), F.col(ident).cast("long").alias("ident"))
    return flat.groupBy("host").applyInPandasWithState(
        step, "host string, ident long, starts double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def breaker(events: DataFrame, key: str, t: str, ident: str, failed, threshold: int) -> DataFrame:
    """Whether a key's circuit is open after each event; the run of failures is the state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, is_open = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(["t", "ident"])
        out = []
        for bad in rows["failed"]:
            run = run + 1 if bad else 0
            is_open = is_open or run >= threshold
            out.append((run, is_open))
        state.update((int(run), bool(is_open)))
        yield pd.DataFrame({"k": [str(k[0])] * len(rows), "ident": rows["ident"].to_numpy(), "run": [r for r, _ in out], "open": [o for _, o in out]})

    ship(events.sparkSession)
    flat = events.select(F.col(key).cast("string").alias("k"), F.col(t).alias("t"), F.col(ident).cast("long").alias("ident"), failed.alias("failed"))
    return flat.groupBy("k").applyInPandasWithState(
        step, "k string, ident long, run int, open boolean", "run int, open boolean", "append", GroupStateTimeout.NoTimeout
    )
