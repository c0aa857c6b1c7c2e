"""Rate control: the adaptive rate's state, and expressions of times, waits and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds after a cut in which further rejections do not cut again; lowest share of the ceiling; gain of a success.
COOLDOWN, FLOOR, GAIN = 2.0, 0.02, 0.02


class Pace:
    """An adaptive request rate: halved on a rejection outside the cooldown, raised a little on a success, within bounds."""

    def __init__(self, ceiling: float, rate: float | None = None, cut_at: float = -1e18, cut: int = 0) -> None:
        self.ceiling, self.cut_at, self.cut = ceiling, cut_at, cut
        self.rate = ceiling if rate is None else rate

    def step(self, t: float, outcome: str | None) -> None:
        if outcome == "rate_limited" and t - self.cut_at >= COOLDOWN:
            self.rate, self.cut_at, self.cut = self.rate / 2, float(t), self.cut + 1
        elif outcome == "accepted":
            self.rate += GAIN * self.ceiling
        self.rate = min(self.ceiling, max(FLOOR * self.ceiling, self.rate))


def job_timeout(pages: Column, base: int, per_page: float, margin: int = 0) -> Column:
    """Seconds a job may take: by its pages, less a margin, never below one."""
    return F.greatest(F.lit(1), F.greatest(F.lit(base), F.floor(pages * per_page)) - margin).cast("int")


def backoff(attempt: Column, base: float, most: float) -> Column:
    """The longest wait before an attempt; the wait itself is a random share of it."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def header_rate(remaining: Column, reset: Column, ceiling: float) -> Column:
    """Requests a second that a provider's own headers allow, within the bounds; null where they say nothing.

    ``ceiling`` is the most a minute; a window that is over or unknown tells nothing.
    """
    most = ceiling / 60.0
    stated = F.when(reset > 0, remaining.cast("double") / reset.cast("double"))
    return F.when(stated.isNotNull(), F.greatest(F.lit(FLOOR * most), F.least(F.lit(most), stated)))


def scan_resolution(edge: Column, base: int, cap: int) -> Column:
    """Dots an inch for a page whose longer edge is ``edge`` points: the base, lowered only so far that the picture fits the cap."""
    if cap <= 0:
        return F.lit(base)
    return F.when(edge > 0, F.greatest(F.lit(1), F.least(F.lit(base), F.floor(F.lit(cap * 72.0) / edge)))).otherwise(base).cast("int")


def relative_time(then: Column, now: Column) -> Column:
    """How long ago a time is, as listings say it."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    day = F.date_format(then, "MMM d")
    return (
        F.when(then.isNull(), "—").when(minutes < 1, "Just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago"))).when(F.year(then) == F.year(now), day)
        .otherwise(F.concat(day, F.lit(", "), F.year(then).cast("string")))
    )
