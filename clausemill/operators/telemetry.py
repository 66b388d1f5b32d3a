"""Time and state over event tables: spacing, breakers, stalls, budgets, windows.

Windows are partitioned by a key (a host, a user); each is a sequence in time by its nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spaced(requests: DataFrame, host: str, t: str, order: list[str], interval: float) -> DataFrame:
    """Adds `starts` and `wait`: requests to a host begin `interval` apart at least, in order.

    start_i = i * interval + max over j <= i of (t_j - j * interval): a running maximum, no recursion.
    """
    w = Window.partitionBy(host).orderBy(t, *order)
    i = F.row_number().over(w).cast("double")
    lead = F.col(t) - i * interval
    numbered = requests.withColumn("_i", i).withColumn("_lead", lead)
    running = F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("starts", F.col("_i") * interval + running).withColumn("wait", F.col("starts") - F.col(t)).drop("_i", "_lead")


def failure_runs(calls: DataFrame, by: list[str], order: list[str], failed: Column, threshold: int) -> DataFrame:
    """Adds `run` (failures in a row up to here) and `open` (a run has reached the threshold by now)."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = calls.withColumn("_failed", failed.cast("int")).withColumn("_group", F.sum(1 - F.col("_failed")).over(so_far))
    inside = Window.partitionBy(*by, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("run", F.sum("_failed").over(inside))
    return runs.withColumn("open", F.max(F.col("run") >= threshold).over(so_far)).drop("_failed", "_group")


def degraded(calls: DataFrame, by: list[str], failed: Column, ratio: float = 0.5) -> DataFrame:
    """Groups and whether more than `ratio` of what was asked failed; nothing asked is not degraded."""
    counts = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"), F.count_if(failed).alias("failed"))
    return counts.withColumn("degraded", (F.col("asked") > 0) & (F.col("failed") > ratio * F.col("asked")))


def stalls(events: DataFrame, by: list[str], t: str, order: list[str], seconds: int) -> DataFrame:
    """Gaps of at least `seconds` to the event before, and how often they would have been reported."""
    gap = F.unix_timestamp(t) - F.unix_timestamp(F.lag(t).over(Window.partitionBy(*by).orderBy(t, *order)))
    found = events.withColumn("gap", gap).where(F.col("gap") >= seconds)
    return found.withColumn("reports", F.floor(F.col("gap") / seconds).cast("long"))


def heartbeat(events: DataFrame, t: str, unit: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by unit of time, and their running totals (a row a unit, not an event)."""
    ticks = events.groupBy(F.date_trunc(unit, t).alias("tick")).agg(*[c.alias(k) for k, c in measures.items()])
    w = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    for k in measures:
        ticks = ticks.withColumn(f"total_{k}", F.sum(k).over(w))
    return ticks


def budget_alarm(ticks: DataFrame, total: str, budget: float) -> DataFrame:
    """The first tick at which the running total is past the budget."""
    return ticks.where(F.col(total) > budget).agg(F.min("tick").alias("tick"), F.min(total).alias(total))


def echoes(results: DataFrame, portal: str, query: str, order: str, item: str, least: int = 3) -> DataFrame:
    """Portals that answered `least` queries or more with one and the same ordered list."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item].cast("string"))
    prints = results.groupBy(portal, query).agg(F.sha2(F.array_join(items, "\n").cast("binary"), 256).alias("fingerprint"))
    return prints.groupBy(portal, "fingerprint").agg(F.count_distinct(query).alias("n_queries")).where(F.col("n_queries") >= least)


def replayed(requests: DataFrame, recorded: DataFrame, key: str = "key") -> DataFrame:
    """What a recording answers; 504 where it has none."""
    r = recorded.select(key, F.col("status").alias("_status"))
    out = requests.join(r, key, "left")
    return out.withColumn("status", F.coalesce("_status", F.lit(504))).withColumn("miss", F.col("_status").isNull()).drop("_status")


def body_watch(chunks: DataFrame, by: list[str], t: str, order: list[str], total: float = 7200.0, idle: float = 180.0) -> DataFrame:
    """Bodies that arrive in chunks: `outcome` (DONE, IDLE or DEADLINE), when the watch cut it, and the chunks until then.

    Silence of `idle` seconds cuts a body, and so does one that takes more than `total` in all; whichever comes first.
    """
    w = Window.partitionBy(*by).orderBy(t, *order)
    first = F.min(t).over(Window.partitionBy(*by))
    before = F.coalesce(F.lag(t).over(w), F.col(t))
    seen = chunks.select(*by, t, *order, first.alias("_first"), before.alias("_before"))
    silent = F.when(F.col(t) - F.col("_before") > idle, F.col("_before") + idle)
    late = F.when(F.col(t) - F.col("_first") > total, F.col("_first") + total)
    # a chunk was read if neither had cut by then: the first silence is known in order, the deadline from the start
    quiet = F.min(silent).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = seen.withColumn("_silent", silent).withColumn("_late", late).withColumn("_read", quiet.isNull() & late.isNull())
    whole = rows.groupBy(*by).agg(F.min("_silent").alias("_silent"), F.min("_late").alias("_late"), F.count_if("_read").alias("chunks"))
    cut = F.least("_silent", "_late")
    outcome = F.when(cut.isNull(), "DONE").when(cut == F.col("_silent"), "IDLE").otherwise("DEADLINE")
    return whole.select(*by, outcome.alias("outcome"), cut.alias("cut_at"), "chunks")
