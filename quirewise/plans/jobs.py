"""Queries of job and rate-control state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import jobs as J
from quirewise.registry import query
from quirewise.sources.tables import table

#: What the events' types stand for.
OUTCOME = """CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'exhausted' ELSE 'accepted' END"""
SECONDS = "epoch(ts)"


def _outcome():
    kind = F.col("event_type")
    return F.when(kind == "error", "rate_limited").when(kind == "signup", "exhausted").otherwise("accepted")


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query(
    f"""WITH e AS (SELECT user_id, {OUTCOME} AS o FROM events) SELECT user_id, count(*) FILTER (WHERE o <> 'exhausted') AS attempts, count(*) FILTER (WHERE o = 'rate_limited') AS rejected,
round(coalesce(100.0 * count(*) FILTER (WHERE o = 'rate_limited') / nullif(count(*) FILTER (WHERE o <> 'exhausted'), 0), 0), 6) AS reject_percent FROM e GROUP BY ROLLUP (user_id)"""
)
def attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and rejections by user and in all."""
    rows = table(spark, sf_dir, "events").select("user_id", _outcome().alias("outcome"))
    return J.attempt_rollup(rows, "user_id", "outcome").withColumn("reject_percent", F.round("reject_percent", 6))


@query(
    """WITH s AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT event_type, h, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY h) AS BIGINT) AS total FROM s)
SELECT event_type, CAST(epoch(h) AS BIGINT) AS hour, total, total - coalesce(lag(total) OVER (PARTITION BY event_type ORDER BY h), 0) AS delta FROM c"""
)
def attempt_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly changes of running counters."""
    from pyspark.sql import Window

    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    counted = table(spark, sf_dir, "events").groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return J.deltas(counted.withColumn("total", running).drop("n"), "event_type", "hour", "total")


@query(
    """WITH m AS (SELECT user_id, event_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS streak FROM m"""
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many failures in a row each event ends."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return J.streaks(rows, "user_id", F.col("event_type") == "error", "event_id").drop("event_type")


_STOPS = """m AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS f FROM events),
r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER w AS ok, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER w AS bad FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ok ORDER BY event_id) AS streak FROM r),
s AS (SELECT *, CASE WHEN ok = 0 AND bad >= 3 THEN 'give_up' WHEN streak >= 3 THEN 'pause' END AS stop FROM k)"""


@query(
    f"""WITH {_STOPS} SELECT user_id, coalesce(arg_min(stop, event_id) FILTER (WHERE stop IS NOT NULL), CASE WHEN bool_or(f) THEN 'attention' ELSE 'done' END) AS "end",
min(event_id) FILTER (WHERE stop IS NOT NULL) AS at FROM s GROUP BY user_id"""
)
def giveup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each run of attempts ends: giving up before pausing before attention."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return J.run_ends(rows, "user_id", F.col("event_type").isin("error", "view"), "event_id", 3)


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, {OUTCOME} AS o, {SECONDS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, rate, cut_at, cut) AS (SELECT DISTINCT user_id, 0::BIGINT, 100.0::DOUBLE, -1e18::DOUBLE, 0 FROM e
UNION ALL SELECT e.user_id, e.i, least(100.0, greatest(2.0, CASE WHEN o = 'rate_limited' AND t - cut_at >= 2 THEN rate / 2 WHEN o = 'accepted' THEN rate + 2.0 ELSE rate END))::DOUBLE,
CASE WHEN o = 'rate_limited' AND t - cut_at >= 2 THEN t ELSE cut_at END::DOUBLE, cut + CASE WHEN o = 'rate_limited' AND t - cut_at >= 2 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(arg_max(rate, i), 6) AS rate, max(cut) AS cut FROM f GROUP BY user_id"""
)
def aimd_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive request rate after all of a user's events."""
    rows = table(spark, sf_dir, "events").select("user_id", _seconds().alias("t"), F.col("event_id").alias("seq"), _outcome().alias("outcome"))
    return J.paced_rates(rows, "user_id", 100.0).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, {SECONDS} AS t, coalesce(value, 0) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, lft, last, waited) AS (SELECT DISTINCT user_id, 0::BIGINT, 50.0::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE FROM e
UNION ALL SELECT e.user_id, e.i, least(50.0, lft + greatest(0.0, t - coalesce(last, t)) * 0.001) - cost, t,
waited + CASE WHEN least(50.0, lft + greatest(0.0, t - coalesce(last, t)) * 0.001) - cost < 0 THEN -(least(50.0, lft + greatest(0.0, t - coalesce(last, t)) * 0.001) - cost) / 0.001 * 1000 ELSE 0 END
FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(arg_max(waited, i), 0) AS waited_ms, round(arg_max(lft, i), 4) AS "left" FROM f GROUP BY user_id"""
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a token bucket makes a user's requests wait."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", _seconds().alias("t"), F.col("event_id").alias("seq"), F.coalesce("value", F.lit(0.0)).alias("cost")
    )
    waits = J.bucket_waits(rows, "user_id", 0.001, 50.0)
    return waits.select("user_id", F.round("waited_ms", 0).alias("waited_ms"), F.round("left", 4).alias("left"))


@query('SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS "round" FROM events')
def lane_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round in which each job's turn comes."""
    return J.fair_order(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(
    f"""WITH e AS (SELECT user_id, event_id, {SECONDS} AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 3600 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM m)
SELECT user_id, session, count(*) AS n, min(t) AS first, max(t) AS last FROM s GROUP BY user_id, session"""
)
def autosave_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events with less than an hour between them."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return J.sessions(rows, "user_id", _seconds(), "event_id", 3600.0)


@query(
    """WITH e AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS state FROM events)
SELECT job, arg_min(state, seq) AS state, min(seq) AS seq FROM e WHERE state IN ('done', 'error') GROUP BY job"""
)
def first_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ending of every job."""
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("running")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), state.alias("state"))
    return J.first_terminal(rows, "job", "state", "seq")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND event_id NOT IN (SELECT o_orderkey FROM orders) THEN 'interrupted' WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS state FROM events"""
)
def orphan_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs that the queue lost are interrupted."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "queued").when(kind == "click", "running").otherwise("done")
    jobs = table(spark, sf_dir, "events").select("event_id", state.alias("state"))
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return J.orphans(jobs, queue, "event_id", "state")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'transient' WHEN 2 THEN 'transient' WHEN 3 THEN 'permanent' WHEN 4 THEN 'permanent' ELSE 'transient' END AS kind,
greatest(1, greatest(120, CAST(floor(o_orderkey % 300 * 1.5) AS INT)) - 30) AS timeout, least(60.0, pow(2.0, o_orderkey % 10)) AS backoff FROM orders"""
)
def retry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure kinds, job timeouts and the bounds of backing off."""
    from quirewise.functions.pacing import backoff, job_timeout

    i = F.col("o_orderkey")
    codes = F.array(*[F.lit(x) for x in ("ok", "503", "429", "504", "404", "transport")])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", J.failure_kind(F.get(codes, i % 6)).alias("kind"), job_timeout(i % 300, 120, 1.5, 30).alias("timeout"), backoff(i % 10, 1.0, 60.0).alias("backoff")
    )


@query(
    """SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type in tumbling hours; the batch twin of the stream."""
    from quirewise.streaming.windows import tumbling_counts

    return tumbling_counts(table(spark, sf_dir, "events"), "1 hour").select(
        F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")
    )


@query(
    """WITH w AS (SELECT unnest([floor(epoch(ts) / 1800) * 1800 - 1800, floor(epoch(ts) / 1800) * 1800]) AS s, event_type FROM events) SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS n FROM w GROUP BY ALL"""
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type in hours that slide by half an hour."""
    from quirewise.streaming.windows import tumbling_counts

    found = tumbling_counts(table(spark, sf_dir, "events"), "1 hour", "30 minutes")
    return found.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type AS stage, {SECONDS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, event_id, stage, at_, out) AS (SELECT user_id, i, event_id, stage, t, true FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN e.stage <> f.stage OR e.t - f.at_ >= 20000 THEN e.stage ELSE f.stage END, CASE WHEN e.stage <> f.stage OR e.t - f.at_ >= 20000 THEN e.t ELSE f.at_ END,
e.stage <> f.stage OR e.t - f.at_ >= 20000 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id FROM f WHERE out"""
)
def progress_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress reports that are written, not more often than stages change or time passes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("stage"), _seconds().alias("t"))
    return J.progress_writes(rows, "user_id", ["t", "event_id"], 20_000.0).select("user_id", "event_id")


@query(
    """WITH r AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL WHEN value > 0 THEN greatest(0.02 * 2, least(2.0, (event_id % 100) / value)) END AS rate FROM events)
SELECT user_id, event_type, round(arg_max(rate, event_id), 9) AS rate, round(arg_max(rate, event_id) * 60, 1) AS per_minute FROM r WHERE rate IS NOT NULL GROUP BY ALL"""
)
def header_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by the last headers that a provider sent."""
    i = F.col("event_id")
    readings = table(spark, sf_dir, "events").select(
        "user_id", "event_type", i.alias("seq"), F.when(i % 5 != 0, i % 100).alias("remaining"), F.when(i % 7 == 0, 0.0).otherwise(F.col("value")).alias("reset")
    )
    return J.latest_rates(readings, ["user_id", "event_type"], "seq", 120.0).withColumn("rate", F.round("rate", 9))


@query(
    f"""WITH e AS (SELECT user_id, event_id, {SECONDS} AS t, CASE event_type WHEN 'purchase' THEN 'request' WHEN 'signup' THEN 'clear' ELSE 'tick' END AS kind FROM events),
l AS (SELECT *, last_value(CASE WHEN kind <> 'tick' THEN kind END IGNORE NULLS) OVER w AS k, last_value(CASE WHEN kind <> 'tick' THEN t END IGNORE NULLS) OVER w AS at_ FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, coalesce(k = 'request' AND t - at_ < 50000, false) AS cancelled FROM l WHERE kind = 'tick'"""
)
def cancel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ticks of a job see a pending request to stop."""
    kind = F.when(F.col("event_type") == "purchase", "request").when(F.col("event_type") == "signup", "clear").otherwise("tick")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", _seconds().alias("t"), kind.alias("kind"))
    return J.cancelled(rows, "user_id", ["t", "event_id"], 50_000.0).select("user_id", "event_id", "cancelled")


@query(
    f"""WITH e AS (SELECT user_id, {OUTCOME} AS o FROM events) SELECT user_id, count(*) FILTER (WHERE o = 'accepted') AS accepted, count(*) FILTER (WHERE o = 'rate_limited') AS rate_limited, count(*) FILTER (WHERE o = 'exhausted') AS exhausted FROM e GROUP BY user_id"""
)
def counter_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of outcomes by user, one column each."""
    rows = table(spark, sf_dir, "events").select("user_id", _outcome().alias("outcome"))
    return J.counters(rows, "user_id", "outcome", ["accepted", "rate_limited", "exhausted"])


@query(
    """WITH c AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_id % 900 END AS i, CASE WHEN event_type <> 'error' THEN event_id % 70 END AS o FROM events)
SELECT user_id, count(*) AS calls, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens, round((coalesce(sum(i), 0) + coalesce(sum(o), 0)) / count(*), 9) AS tokens_per_call,
round(coalesce(sum(i), 0) * 0.0000003 + coalesce(sum(o), 0) * 0.0000025, 9) AS usd FROM c GROUP BY user_id"""
)
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost by user."""
    used = F.col("event_type") != "error"
    calls = table(spark, sf_dir, "events").select(
        "user_id", F.when(used, F.col("event_id") % 900).alias("input_tokens"), F.when(used, F.col("event_id") % 70).alias("output_tokens")
    )
    return J.call_costs(calls, "user_id", 0.0000003, 0.0000025).withColumns({c: F.round(c, 9) for c in ("tokens_per_call", "usd")})


@query(
    """SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id HAVING count(*) > 1"""
)
def double_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break the rule of one active job."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "queued").when(kind == "click", "running").otherwise("done")
    return J.one_active(table(spark, sf_dir, "events").select("user_id", state.alias("state")), "user_id", "state")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, round(epoch(min(ts)), 3) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that six hours without events end; the batch twin of the stream."""
    from quirewise.streaming.windows import session_counts

    found = session_counts(table(spark, sf_dir, "events"), "6 hours")
    return found.select("user_id", F.round(F.unix_micros("window.start") / 1e6, 3).alias("start"), "n")


@query(f"WITH e AS (SELECT user_id, {OUTCOME} AS outcome FROM events) SELECT user_id, outcome, count(*) AS n FROM e WHERE outcome <> 'exhausted' GROUP BY ALL")
def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by user and outcome; the batch twin of the stream."""
    from quirewise.streaming.windows import attempt_counts as counted

    return counted(table(spark, sf_dir, "events").select("ts", "user_id", _outcome().alias("outcome")))


@query(
    """WITH e AS (SELECT event_id, ts, (epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(ts)) / 60 AS q FROM events), m AS (SELECT *, floor(q + 0.5) AS mins FROM e), h AS (SELECT *, floor(mins / 60 + 0.5) AS hours FROM m), d AS (SELECT *, floor(hours / 24 + 0.5) AS days FROM h)
SELECT event_id, CASE WHEN mins < 1 THEN 'Just now' WHEN mins < 60 THEN CAST(mins AS INTEGER) || 'm ago' WHEN hours < 24 THEN CAST(hours AS INTEGER) || 'h ago' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN CAST(days AS INTEGER) || 'd ago' ELSE strftime(ts, '%b %-d') END AS label FROM d"""
)
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each event was, as a listing says it."""
    from quirewise.functions.pacing import relative_time

    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    return table(spark, sf_dir, "events").select("event_id", relative_time(F.col("ts").cast("timestamp"), now).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 200 ELSE greatest(1, least(200, CAST(floor(3500 * 72 / (p_size * 60.0)) AS INT))) END AS dpi FROM part")
def scan_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution at which pages of these sizes are scanned."""
    from quirewise.functions.pacing import scan_resolution

    edge = F.when(F.col("p_size") % 9 == 0, 0).otherwise(F.col("p_size") * 60)
    return table(spark, sf_dir, "part").select("p_partkey", scan_resolution(edge, 200, 3500).alias("dpi"))
