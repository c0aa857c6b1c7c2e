"""Job and rate-control state in batch: folds over ordered events, streaks, rollups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quirewise.columns import extended, map_arrow
from quirewise.functions.pacing import Pace, header_rate
from quirewise.operators.graph import checkpoint
from quirewise.operators.order import by_key, spare
from quirewise.session import ship

#: Events that end a job.
TERMINAL = ("done", "error", "paused", "needs_attention", "cancelled", "interrupted")
ACTIVE = ("queued", "running")


def failure_kind(outcome: Column) -> Column:
    """Whether an attempt may be repeated: server faults, rate limits and transport are transient."""
    code = outcome.try_cast("int")
    return (
        F.when(outcome == "ok", "success")
        .when(outcome.isin("daily_quota", "deadline") | (code == 504), "permanent")
        .when(outcome.isin("transport", "rate_limited") | (code == 429) | (code >= 500), "transient")
        .otherwise("permanent")
    )


def first_terminal(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """``key, state, order`` of the first ending of each job: later ones lose."""
    ends = events.where(F.col(state).isin(*TERMINAL))
    return ends.groupBy(key).agg(F.min_by(state, order).alias(state), F.min(order).alias(order))


def one_active(jobs: DataFrame, document: str, state: str) -> DataFrame:
    """Documents that break the rule of one active job."""
    return jobs.where(F.col(state).isin(*ACTIVE)).groupBy(document).agg(F.count("*").alias("n")).where("n > 1")


def streaks(events: DataFrame, key: str, failed: Column, order: str) -> DataFrame:
    """Events with the length of the run of failures that ends with them; a success is 0."""
    f, run = spare(events, "_f"), spare(events, "_run")
    by_event = Window.partitionBy(key).orderBy(order)
    marked = events.withColumn(f, failed).withColumn(
        run, F.sum(F.when(F.col(f), 0).otherwise(1)).over(by_event.rowsBetween(Window.unboundedPreceding, 0))
    )
    within = Window.partitionBy(key, run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.when(F.col(f), 1).otherwise(0)).over(within)).drop(f, run)


def run_ends(events: DataFrame, key: str, failed: Column, order: str, limit: int) -> DataFrame:
    """``key, end, at``: how each run ends, and at which event.

    Giving up (no success so far, and ``limit`` failures) is tested before
    pausing (``limit`` failures in a row); then attention for any failure.
    """
    counted = streaks(events.withColumn("_fail", failed), key, F.col("_fail"), order)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    facts = counted.withColumns(
        {"_ok": F.sum(F.when(F.col("_fail"), 0).otherwise(1)).over(upto), "_bad": F.sum(F.when(F.col("_fail"), 1).otherwise(0)).over(upto)}
    )
    stop = F.when((F.col("_ok") == 0) & (F.col("_bad") >= limit), "give_up").when(F.col("streak") >= limit, "pause")
    stopped = facts.withColumn("_stop", stop)
    first = F.min(F.when(F.col("_stop").isNotNull(), F.struct(order, "_stop")))
    grouped = stopped.groupBy(key).agg(first.alias("_s"), F.bool_or("_fail").alias("_any"))
    end = F.coalesce(F.col("_s._stop"), F.when(F.col("_any"), "attention").otherwise("done"))
    return grouped.select(key, end.alias("end"), F.col(f"_s.{order}").alias("at"))


def paced_rates(events: DataFrame, key: str, ceiling: float) -> DataFrame:
    """``key, rate, cut``: the request rate after all events, and how often it was halved.

    ``events`` gives ``key, t, seq, outcome``.  Whether a rejection cuts depends on
    when the last cut was, so a key's events pass in order; a task holds one state.
    """
    ship(events.sparkSession)
    dealt = events.select(key, "t", "seq", "outcome").repartition(key).sortWithinPartitions(key, "t", "seq")
    kind = to_arrow_type(dealt.schema[key].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, Pace(ceiling), False
        for batch in batches:
            done = []
            for k, t, outcome in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if not begun or k != now:
                    if begun:
                        done.append((now, state.rate, state.cut))
                    now, state, begun = k, Pace(ceiling), True
                state.step(t, outcome)
            if done:
                yield rows_of(done)
        if begun:
            yield rows_of([(now, state.rate, state.cut)])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), (kind, pa.float64(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "rate", "cut"])

    return map_arrow(dealt, run, extended([dealt.schema[key]], rate=T.DoubleType(), cut=T.IntegerType()))


def bucket_waits(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """``key, waited_ms, left``: what a token bucket makes each request wait, in all, and what it holds at the end.

    ``events`` gives ``key, t, seq, cost``.  Events are dealt by ranges of key and
    time.  What a run of requests does to a level is ``min(a, level + b)``, and two
    such functions in turn are one again, so the driver gets a few numbers for the
    last run of each partition and gives each partition the state that it begins
    with.  No task holds a key's events, however many there are.
    """
    ship(events.sparkSession)
    order = [key, "t", "seq"]
    rows = events.select(*order, F.col("cost").cast("double").alias("cost"))
    dealt = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    names, kind = [key, "t", "cost"], dealt.schema[key]

    def last_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, whole = TaskContext.get().partitionId(), None, None, True
        for run in by_key(batches, names):
            first, whole = (run[key][0], True) if last is None else (first, False)
            last = run
        if last is not None:
            t, cost = np.array(last["t"], float), np.array(last["cost"], float)
            total = np.cumsum(np.concatenate(([0.0], np.diff(t) * rate)) - cost)
            # The level after all, of a level y at the first request: y + total[-1], or what a full bucket leaves since the second.
            most = float((burst - cost[1:] - total[1:]).min() + total[-1]) if len(t) > 1 else float("inf")
            numbers = [float(t[0]), float(t[-1]), most, float(total[-1])]
            columns = [pa.array([part], pa.int32()), pa.array([first], to_arrow_type(kind.dataType)), pa.array([last[key][0]], to_arrow_type(kind.dataType))]
            columns += [pa.array([whole]), pa.array([numbers], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "whole", "numbers"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind.dataType), T.StructField("last", kind.dataType)])
    schema = schema.add("whole", T.BooleanType()).add("numbers", T.ArrayType(T.DoubleType()))
    begins: dict[int, tuple[float, float]] = {}
    before, state = None, None
    for r in sorted(map_arrow(dealt.select(*names), last_runs, schema).collect(), key=lambda r: r.part):
        goes_on = before is not None and before.last == r.first
        if goes_on:
            begins[r.part] = state
        start, end, most, total = r.numbers
        left, since = state if goes_on and r.whole else (burst, start)
        state = min(most, min(burst, left + max(0.0, start - since) * rate) + total), end
        before = r

    def waits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opening = TaskContext.get().partitionId(), True
        for run in by_key(batches, names):
            left, since = begins.get(part, (burst, None)) if opening else (burst, None)
            opening, waited = False, 0.0
            for t, cost in zip(run["t"], run["cost"], strict=True):
                left = min(burst, left + max(0.0, t - (t if since is None else since)) * rate) - cost
                waited, since = waited + (-left / rate * 1000 if left < 0 else 0.0), t
            columns = [pa.array(run[key][:1], to_arrow_type(kind.dataType)), pa.array([part], pa.int32()), pa.array([waited]), pa.array([left])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "part", "waited", "left"])

    parts = map_arrow(dealt.select(*names), waits, extended([kind], part=T.IntegerType(), waited=T.DoubleType(), left=T.DoubleType()))
    return parts.groupBy(key).agg(F.sum("waited").alias("waited_ms"), F.max_by("left", "part").alias("left"))


def attempt_rollup(events: DataFrame, model: str, outcome: str) -> DataFrame:
    """Attempts, rejections and their share by model, with a total row (null model); ``exhausted`` is no attempt."""
    tried, rejected = F.count_if(F.col(outcome) != "exhausted"), F.count_if(F.col(outcome) == "rate_limited")
    return events.rollup(model).agg(
        tried.alias("attempts"), rejected.alias("rejected"), F.coalesce(F.try_divide(100.0 * rejected, tried), F.lit(0.0)).alias("reject_percent")
    )


def attempt_statistics(events: DataFrame, model: str, outcome: str) -> DataFrame:
    """Attempts, accepted and rejected calls, the rejected share, waits, and accepted calls a minute, with a total row (null model).

    ``events`` gives ``model, outcome, wait_ms, t``, in seconds; ``exhausted`` is no
    attempt.  Minutes are those between the first and the last event of all.
    """
    count = lambda value: F.count_if(F.col(outcome) == value)
    tried, accepted, rejected = F.count_if(F.col(outcome) != "exhausted"), count("accepted"), count("rate_limited")
    span = events.agg(((F.max("t") - F.min("t")) / 60.0).alias("_minutes"))
    summed = events.rollup(model).agg(
        tried.alias("attempts"), accepted.alias("accepted"), rejected.alias("rejected"),
        F.coalesce(F.try_divide(100.0 * rejected, tried), F.lit(0.0)).alias("reject_percent"),
        (F.coalesce(F.sum("wait_ms"), F.lit(0)) / 1000.0).alias("wait_s"),
    )
    timed = summed.crossJoin(F.broadcast(span))  # one row
    return timed.withColumn("accepted_a_minute", F.try_divide(F.col("accepted").cast("double"), F.col("_minutes"))).drop("_minutes")


def deltas(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Snapshots with the change since the one before; a first one counts from 0."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return snapshots.withColumn("delta", F.col(value) - F.coalesce(before, F.lit(0)))


def fair_order(queue: DataFrame, user: str, order: str) -> DataFrame:
    """``round, user`` places of jobs: users take turns, each in its own order."""
    return queue.withColumn("round", F.row_number().over(Window.partitionBy(user).orderBy(order)))


def sessions(events: DataFrame, key: str, seconds: Column, order: str, gap: float) -> DataFrame:
    """``key, session, n, first, last``: bursts of events that a pause of ``gap`` seconds separates."""
    by_time = Window.partitionBy(key).orderBy("_t", order)
    timed = events.withColumn("_t", seconds)
    fresh = F.when(F.col("_t") - F.lag("_t").over(by_time) < gap, 0).otherwise(1)
    numbered = timed.withColumn("_n", fresh).withColumn("session", F.sum("_n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("_t").alias("first"), F.max("_t").alias("last"))


def orphans(jobs: DataFrame, queue: DataFrame, key: str, state: str) -> DataFrame:
    """Jobs, those active ones interrupted that the queue does not hold."""
    held = queue.select(key, F.lit(True).alias("_held")).distinct()
    lost = F.col(state).isin(*ACTIVE) & F.col("_held").isNull()
    return jobs.join(held, key, "left").withColumn(state, F.when(lost, "interrupted").otherwise(F.col(state))).drop("_held")


def progress_writes(reports: DataFrame, key: str, order: list[str], seconds: float) -> DataFrame:
    """The progress reports that are written: a change of stage, or ``seconds`` after the last one written.

    ``reports`` gives ``key, stage, t`` and the columns of ``order``.  A job's
    reports pass in order through one task, which holds only the last one written.
    """
    ship(reports.sparkSession)
    dealt = reports.repartition(key).sortWithinPartitions(key, *order)
    schema = extended(reports.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, stage, at, none = None, None, 0.0, True
        for batch in batches:
            keep = []
            for k, s, t in zip(*(batch.column(c).to_pylist() for c in (key, "stage", "t")), strict=True):
                written = none or k != job or s != stage or t - at >= seconds
                if written:
                    job, stage, at, none = k, s, t, False
                keep.append(written)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(dealt, run, schema)


def latest_rates(readings: DataFrame, key: list[str], order: str, ceiling: float) -> DataFrame:
    """``key, rate, per_minute`` by the last reading of a provider's headers that says anything."""
    rated = readings.withColumn("_rate", header_rate(F.col("remaining"), F.col("reset"), ceiling)).where("_rate IS NOT NULL")
    last = rated.groupBy(*key).agg(F.max_by("_rate", order).alias("rate"))
    return last.withColumn("per_minute", F.round(F.col("rate") * 60, 1))


def cancelled(events: DataFrame, key: str, order: list[str], seconds: float) -> DataFrame:
    """Ticks with ``cancelled``: whether a request to stop, not cleared and not older than ``seconds``, is pending.

    ``events`` gives ``key, t, kind`` with kinds ``request``, ``clear`` and ``tick``.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") != "tick", F.struct("kind", "t")), ignorenulls=True).over(upto)
    pending = (F.col("_last.kind") == "request") & (F.col("t") - F.col("_last.t") < seconds)
    return events.withColumn("_last", last).where("kind = 'tick'").withColumn("cancelled", F.coalesce(pending, F.lit(False))).drop("_last")


def counters(events: DataFrame, model: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """A column for each of the outcomes with its count by model."""
    return events.groupBy(model).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])


def call_costs(calls: DataFrame, key: str, input_price: float, output_price: float) -> DataFrame:
    """``key, calls, input_tokens, output_tokens, tokens_per_call, usd``; a call without usage counts as a call."""
    n, into, out = F.count("*"), F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    sums = calls.groupBy(key).agg(n.alias("calls"), into.cast("bigint").alias("input_tokens"), out.cast("bigint").alias("output_tokens"))
    return sums.withColumns(
        {
            "tokens_per_call": F.coalesce(F.try_divide((F.col("input_tokens") + F.col("output_tokens")).cast("double"), F.col("calls").cast("double")), F.lit(0.0)),
            "usd": F.col("input_tokens") * F.lit(input_price) + F.col("output_tokens") * F.lit(output_price),
        }
    )


def accepted_states(events: DataFrame, key: str, order: str) -> DataFrame:
    """The changes of a job's state that are accepted: none after its first ending, and none that changes nothing.

    The batch twin of the stream of job states.
    """
    ended = first_terminal(events, key, "state", order).select(key, F.col(order).alias("_end"))
    before = F.lag("state").over(Window.partitionBy(key).orderBy(order))
    live = events.join(ended, key, "left").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).withColumn("_was", before)
    return live.where(F.col("_was").isNull() | (F.col("_was") != F.col("state"))).drop("_end", "_was")
