import uuid

from pyspark.sql import functions as F

from clausemill.streaming import events as streams

SF = "/root/testdata/sf0.001"


def run(spark, df, mode, folder):
    name = f"q_{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").limit(300)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    return e, streams.read_events(spark, f"{tmp_path}/in", e.schema)


def test_spacing_matches_the_batch_form(spark, tmp_path):
    from clausemill.operators.telemetry import spaced

    e, s = source(spark, tmp_path)
    got = {(r.host, r.ident): r.starts for r in run(spark, streams.spaced(s, "event_type", "ts", "event_id", 50.0), "append", tmp_path).collect()}
    flat = e.select("event_type", "event_id", F.unix_timestamp("ts").cast("double").alias("t"))
    want = {(r.event_type, r.event_id): r.starts for r in spaced(flat, "event_type", "t", ["event_id"], 50.0).collect()}
    assert got == want


def test_breaker_matches_the_batch_form(spark, tmp_path):
    from clausemill.operators.telemetry import failure_runs

    e, s = source(spark, tmp_path)
    bad = F.col("event_type").isin("error", "click")
    got = {r.ident: (r.run, r.open) for r in run(spark, streams.breaker(s, "user_id", "ts", "event_id", bad, 2), "append", tmp_path).collect()}
    want = {r.event_id: (r.run, r.open) for r in failure_runs(e, ["user_id"], ["ts", "event_id"], bad, 2).collect()}
    assert got == want


def test_repeats_are_dropped(spark, tmp_path):
    e, _ = source(spark, tmp_path)
    e.union(e).coalesce(1).write.parquet(f"{tmp_path}/twice")
    s = streams.read_events(spark, f"{tmp_path}/twice", e.schema)
    assert run(spark, streams.once(s, ["event_id"], "40 days"), "append", tmp_path).count() == e.count()
