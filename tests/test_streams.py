"""Streams give what the batch twins give."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirewise.operators import jobs as J
from quirewise.streaming import states, windows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "data")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(path)
    return path


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_tumbling(spark, folder, tmp_path):
    batch = windows.tumbling_counts(spark.read.parquet(folder), "1 day").select("window.start", "event_type", "n")
    live = run(windows.tumbling_counts(stream(spark, folder), "1 day"), "tumbling", "complete", tmp_path).select("window.start", "event_type", "n")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, live.collect()))


def test_pacing(spark, folder, tmp_path):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "rate_limited").when(kind == "signup", "exhausted").otherwise("accepted")
    cut = lambda df: df.select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), F.col("event_id").alias("seq"), outcome.alias("outcome"))
    batch = {r.user_id: (round(r.rate, 9), r.cut) for r in J.paced_rates(cut(spark.read.parquet(folder)), "user_id", 100.0).collect()}
    live = run(states.paced_rates(cut(stream(spark, folder)), 100.0), "pacing", "update", tmp_path)
    # The sink keeps batches in order, so a user's last row is its state after all events.
    last = live.withColumn("_at", F.monotonically_increasing_id()).groupBy("user_id").agg(F.max_by(F.struct("rate", "cut"), "_at").alias("r"))
    assert {r.user_id: (round(r.r.rate, 9), r.r.cut) for r in last.collect()} == batch


def test_sessions_and_attempts(spark, folder, tmp_path):
    batch = windows.session_counts(spark.read.parquet(folder), "6 hours").select("user_id", "window.start", "n")
    live = run(windows.session_counts(stream(spark, folder), "6 hours", "60 days"), "sessions", "complete", tmp_path / "s").select("user_id", "window.start", "n")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, live.collect()))
    rename = lambda df: df.withColumnRenamed("event_type", "outcome")
    counts = windows.attempt_counts(rename(spark.read.parquet(folder)))
    seen = run(windows.attempt_counts(rename(stream(spark, folder))), "attempts", "complete", tmp_path / "a")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, seen.collect()))


def test_jobs_end_once(spark, folder, tmp_path):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "done").when(kind == "error", "error").otherwise("running")
    cut = lambda df: df.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), state.alias("state"))
    live = run(states.job_states(cut(stream(spark, folder)), keep_ms=3_600_000), "jobs", "append", tmp_path)
    ends = live.where("state IN ('done', 'error')").groupBy("job").count()
    assert ends.where("count > 1").count() == 0 and ends.count() > 0
