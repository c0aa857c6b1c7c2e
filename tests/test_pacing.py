"""Pacing over whole tables, against plain folds of each key's events."""

from __future__ import annotations

import random

import pytest

from quirewise.operators import jobs as J


@pytest.fixture
def many_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def rows():
    """One key has most events and runs through several partitions; others have one or a few."""
    rng, out, seq = random.Random(1), [], 0
    for key, n in [(1, 1), (2, 900), (3, 2), (None, 40), *[(k, rng.randint(1, 5)) for k in range(10, 60)]]:
        t = 1000.0
        for _ in range(n):
            seq += 1
            t += rng.choice([0.0, 0.1, 0.5, 3.0, 60.0])
            out.append((key, t, seq, rng.choice([0.0, 1.0, 5.0, 40.0]), rng.choice(["accepted", "accepted", "rate_limited", "exhausted", None])))
    rng.shuffle(out)
    return out


def by_key(rows):
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        found.setdefault(r[0], []).append(r)
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, t double, seq long, cost double, outcome string").repartition(3)


def test_bucket(spark, rows, many_partitions):
    rate, burst, want = 1.5, 20.0, {}
    for key, events in by_key(rows).items():
        left, last, waited = burst, None, 0.0
        for _, t, _, cost, _ in events:
            left = min(burst, left + (0.0 if last is None else t - last) * rate) - cost
            waited, last = waited + max(0.0, -left / rate * 1000), t
        want[key] = waited, left
    got = {r.k: (r.waited_ms, r.left) for r in J.bucket_waits(frame(spark, rows), "k", rate, burst).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-6, rel=1e-9)
    assert J.bucket_waits(frame(spark, rows).limit(0), "k", rate, burst).count() == 0


def test_rates(spark, rows, many_partitions):
    want = {}
    for key, events in by_key(rows).items():
        rate, cut_at, cut = 80.0, -1e18, 0
        for _, t, _, _, outcome in events:
            if outcome == "rate_limited" and t - cut_at >= 2:
                rate, cut_at, cut = rate / 2, t, cut + 1
            elif outcome == "accepted":
                rate += 1.6
            rate = min(80.0, max(1.6, rate))
        want[key] = rate, cut
    got = {r.k: (r.rate, r.cut) for r in J.paced_rates(frame(spark, rows), "k", 80.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert J.paced_rates(frame(spark, rows).limit(0), "k", 80.0).count() == 0
