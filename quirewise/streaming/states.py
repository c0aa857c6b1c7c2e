"""Keyed state over streams: job lifecycles and pacing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirewise.functions.pacing import Pace
from quirewise.session import ship


def _timeout(keep_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def job_states(
    events: DataFrame, terminal: tuple[str, ...] = ("done", "error", "paused", "cancelled", "interrupted"), keep_ms: int | None = None
) -> DataFrame:
    """``job, state, seq``: a row for every accepted change of a job's state.

    ``events`` gives ``job, seq, state``.  The first ending stays: what comes
    after it is ignored.  With ``keep_ms`` the state of a job that has ended is
    forgotten that long after its last event; without, it is kept for ever.
    """
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, last = state.get if state.exists else ("", -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, new in zip(rows["seq"], rows["state"], strict=True):
            if now in terminal:
                break
            if seq > last and new != now:
                now, last = str(new), int(seq)
                out.append((key[0], now, last))
        state.update((now, last))
        if keep_ms is not None and now in terminal:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["job", "state", "seq"])

    return events.groupBy("job").applyInPandasWithState(
        step, "job long, state string, seq long", "state string, seq long", "append", _timeout(keep_ms)
    )


def paced_rates(events: DataFrame, ceiling: float, keep_ms: int | None = None) -> DataFrame:
    """``user_id, rate, cut`` after each micro-batch, by the transition of the batch fold.

    ``events`` gives ``user_id, t, seq, outcome``.  With ``keep_ms`` a user without
    events for that long is forgotten and begins again at the ceiling.
    """
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pace = Pace(ceiling, *state.get) if state.exists else Pace(ceiling)
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        for t, outcome in zip(rows["t"], rows["outcome"], strict=True):
            pace.step(t, outcome)
        state.update((pace.rate, pace.cut_at, pace.cut))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame([(key[0], pace.rate, pace.cut)], columns=["user_id", "rate", "cut"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, rate double, cut int", "rate double, cut_at double, cut int", "update", _timeout(keep_ms)
    )
