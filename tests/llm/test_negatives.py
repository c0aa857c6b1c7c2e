"""Hard negatives by cover trees, against brute force over all products."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.llm import negatives


def brute(rows, positives=5, most=10):
    """Rows of (anchor, positive, rank, negative, scores); anchors are ids divisible by 10."""
    v = []
    for i, label, e in rows:
        if label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((i, label, [math.floor(256 * x) for x in e]))
    out = []
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, (anchor, label, q) in enumerate(v):
        if anchor is None or anchor % 10:
            continue
        scored = [(i, sum(x * y for x, y in zip(q, e)), lab == label) for b, (i, lab, e) in enumerate(v) if b != a and len(e) == len(q)]
        near = sorted((r for r in scored if r[2]), key=key)[:positives]
        for pid, ps, _ in near:
            fit = sorted((r for r in scored if not r[2] and 30 * ps <= 100 * r[1] <= 90 * ps), key=key)[:most]
            out += [(anchor, pid, k + 1, r[0], ps, r[1]) for k, r in enumerate(fit)]
    return Counter(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit("clash"))
    got = negatives.mine(frame.repartition(3), F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    out = [(i, int(rng.integers(4)), (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.6])).tolist()) for i in range(600)]
    same = out[17][2]
    out += [(1000 + i, i % 4, same) for i in range(150)]  # a large group of copies over all labels
    out += [(1200, None, same), (1201, 1, None), (1210, 1, []), (1220, 1, [1.0, None]), (1230, 1, [float("nan")] * 8), (1240, 2, [float("inf")] * 8)]
    out += [(1250, 2, [0.0] * 8), (1260, 1, [1.0, 2.0]), (1261, 1, [1.0, 2.5]), (1262, 2, [1.0, 1.0]), (None, 1, same), (None, 2, same), out[20], out[20], (1300, 77, same)]
    return out


def test_against_brute_force(spark, rows):
    want = brute(rows)
    assert len(want) > 1000
    assert found(spark, rows) == want


def test_many_blocks(spark, rows):
    """Blocks of 64 rows under several pivots, and other numbers of positives and negatives."""
    assert found(spark, rows, block_rows=64) == brute(rows)
    assert found(spark, rows, block_rows=64, positives=2, negatives=3) == brute(rows, 2, 3)


def test_large_numbers(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(-(2**22), 2**22)) for _ in range(3)]) for i in range(60)]
    assert found(spark, rows) == brute(rows)
    huge = np.array([[1e300, 2.0]]), np.array([[1e300, 1.0], [-1e300, 1.0]])
    assert negatives.products(*huge).tolist() == [[negatives.MOST, negatives.LEAST]]


def test_empty_tables(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None, None), (None, 1, None)]) == Counter()
    assert found(spark, [(10, 1, [1.0]), (11, 2, [1.0])]) == Counter()


def test_nodes_cover_and_bound():
    """Every node covers its candidates within its radius, and its bounds hold for their products."""
    rng = np.random.default_rng(3)
    points = np.floor(256 * np.concatenate([rng.normal(size=(900, 6)), np.zeros((200, 6)), rng.normal(size=(40, 6)) * 0.01]))
    norm = float(np.linalg.norm(points, axis=1).max())
    n = len(points)
    tree = negatives.build(points, np.arange(n), np.arange(n), np.ones(n, bool), [str(i % 3) for i in range(n)], np.full(n, 6), norm)
    space = negatives.augmented(tree.points, norm)
    queries = np.floor(256 * rng.normal(size=(20, 6)))
    up, down = negatives.bounds(queries, tree.centres, tree.radius, norm)
    leaves = 0
    for i in range(len(tree.radius)):
        part = slice(tree.low[i], tree.high[i])
        assert negatives.apart(space[part], tree.centres[i]).max() <= tree.radius[i] + 1e-9
        score = negatives.products(queries, tree.points[part])
        assert (score <= up[:, i : i + 1]).all() and (score >= down[:, i : i + 1]).all()
        if tree.last[i]:
            kids = range(tree.child[i], tree.last[i])
            assert sum(tree.high[k] - tree.low[k] for k in kids) == tree.high[i] - tree.low[i]
        else:
            leaves += tree.high[i] - tree.low[i]
    assert leaves == n and len(tree.radius) > 20


def test_descent_skips_nodes(monkeypatch):
    """On clustered candidates most leaves are never looked at."""
    rng = np.random.default_rng(8)
    points = np.floor(256 * (np.repeat(rng.normal(size=(60, 8)), 60, axis=0) + rng.normal(size=(3600, 8)) * 0.02))
    norm, n, seen = float(np.linalg.norm(points, axis=1).max()), 3600, []
    tree = negatives.build(points, np.arange(n), np.arange(n), np.ones(n, bool), ["x"] * n, np.full(n, 8), norm)
    real = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    queries = points[:50]
    limits = [np.full(50, x, np.int64) for x in (negatives.LEAST, negatives.MOST, negatives.LEAST)]
    q, c, s = negatives.search(tree, negatives.Asked(queries, np.full(50, 8), np.arange(50), ["x"] * 50, *limits), True, 5)
    assert sum(seen) < 0.3 * 50 * n
    score = real(queries, tree.points)
    score[tree.rows[None, :] == np.arange(50)[:, None]] = negatives.LEAST
    for i in range(50):
        assert s[q == i].tolist() == np.sort(score[i])[::-1][:5].tolist()
