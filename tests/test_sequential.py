"""Sequential segmentation and boundary models."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quirewise.operators import learn as L
from quirewise.operators import sequential as Q
from quirewise.operators.sequential import accumulate, search


def test_search_finds_all_with_right_verdicts():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 60)
        true = sorted({1, *rng.sample(range(1, n + 1), rng.randint(0, min(n, 8)))})
        end = lambda s: next((t for t in true if t > s), n + 1) - 1  # noqa: E731, B023
        new = lambda s, p: p > end(s)  # noqa: E731, B023
        assert search(new, None, 1, n) == true
        assert search(new, set(true), 1, n) == true


def test_false_splits_are_vetoed():
    new = lambda s, p: p >= 5 and s < 5 or p >= 9 and s < 9
    assert search(new, None, 1, 12) == [1, 5, 9]
    assert search(new, {9}, 1, 12) == [1, 9]
    # A boundary one page off moves to the confirmed page.
    assert search(lambda s, p: p >= 5 and s < 4, {4}, 1, 8) == [1, 4]


def test_search_ends_on_noise():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(2, 40)
        noisy = {(s, p) for s in range(1, n + 1) for p in range(1, n + 1) if rng.random() < 0.4}
        sure = {p for p in range(1, n + 1) if rng.random() < 0.3}
        for confirmed in (None, sure):
            found = search(lambda s, p: (s, p) in noisy, confirmed, 1, n)  # noqa: B023
            assert found == sorted(set(found)) and found[0] == 1 and found[-1] <= n


def test_accumulate():
    assert accumulate([(1, 3), (3, 4), (1, 4)], 5) == [1, 3, 4]
    assert accumulate([], 0) == [] and accumulate([], 3) == [1]


def test_models(spark):
    rng = random.Random(3)
    rows = [(r, float(x), int(x + rng.gauss(0, 0.3) > 0.8)) for r in "abc" for x in [rng.random() for _ in range(80)]]
    frame = spark.createDataFrame(rows, "rec string, x double, label int")
    scored = L.leave_one_out(frame, "rec", ["x"], "label")
    assert scored.count() == 240
    means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.1
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["page one of report", "report page one", "cover letter", "letter and report"])], "i long, text string")
    model = L.weighted_terms(texts, "text").fit(texts)
    assert model.transform(texts).where("features IS NOT NULL").count() == 4


def fold_scores(rows, record):
    """Scores of one record's rows by a model that is fitted on the others alone, scaled by them."""
    train = [r for r in rows if r[0] != record and r[3] is not None]
    x, y = np.array([r[1:3] for r in train], float), np.array([r[3] for r in train], float)
    mean, spread = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, ridge = np.zeros(3), np.diag([0.0, 1, 1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    mine = np.array([r[1:3] for r in rows if r[0] == record], float)
    return 1 / (1 + np.exp(-np.column_stack([np.ones(len(mine)), (mine - mean) / spread]) @ beta))


def test_all_folds_at_once_equal_each_fold_alone(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        for _ in range(rng.randint(1, 30)):
            x, z = rng.gauss(i % 3, 1), rng.random() * 100
            rows.append((None if i == 7 else f"r{i}", x, z, rng.choice([None, int(x + z / 50 + rng.gauss(0, 1) > 2)]) if rng.random() < 0.2 else int(x + z / 50 + rng.gauss(0, 1) > 2)))
    frame = spark.createDataFrame(rows, "rec string, x double, z double, label int").repartition(5)
    got: dict = {}
    for r in L.leave_one_out(frame, "rec", ["x", "z"], "label").collect():
        got.setdefault(r.rec, []).append(r.score)
    for record in {r[0] for r in rows}:
        assert np.allclose(sorted(got[record]), sorted(fold_scores(rows, record)), atol=1e-9)
    one_class = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0), ("c", None, 1)], "rec string, x double, label int")
    assert {r.rec: r.score for r in L.leave_one_out(one_class, "rec", ["x"], "label").collect()} == {"a": 0.0, "b": 1.0, "c": None}
    alone = spark.createDataFrame([("a", 1.0, 1)], "rec string, x double, label int")
    assert L.leave_one_out(alone, "rec", ["x"], "label").first().score is None
    assert L.leave_one_out(frame.limit(0), "rec", ["x", "z"], "label").count() == 0


def test_rounds_read_blocks_of_training_rows(spark):
    """A round reads a few blocks, which hold each row that trains once, and not the rows again."""
    rows = [(None if i % 3 == 0 else f"r{i % 3}", float(i), None if i % 10 == 0 else i % 2, float("nan") if i % 11 == 0 else 1.0) for i in range(5000)]
    frame = spark.createDataFrame(rows, "rec string, x double, label int, y double").repartition(3)
    folds = L._folds(frame, "rec", ["x", "y"], "label")
    blocks = L._blocks(frame, folds, "rec", ["x", "y"], "label").collect()
    got = []
    for b in blocks:
        own, labels, points = np.frombuffer(b.own, np.int64), np.frombuffer(b.labels), np.frombuffer(b.points).reshape(-1, 3)
        got += [(folds.records[i], round(float(p[1] * folds.scale[0] + folds.centre[0])), int(y)) for i, y, p in zip(own, labels, points, strict=True)]
    want = [(r, round(x), y) for r, x, y, z in rows if y is not None and z == z]
    assert len(blocks) <= 3 and sorted(map(str, got)) == sorted(map(str, want))


def test_thousands_of_records(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2000, float(x), int(x > 0.3 * rng.normal())) for i, x in enumerate(rng.normal(size=6000))]
    scored = L.leave_one_out(spark.createDataFrame(rows, "rec int, x double, label int"), "rec", ["x"], "label").collect()
    assert len(scored) == 6000 and all(0 < r.score < 1 for r in scored)


def test_boundary_model_scores_every_language(spark, tmp_path):
    from quirewise.queries import QUERIES

    rng = random.Random(4)
    text = lambda: "\n".join("x" * rng.randint(1, 30) for _ in range(12))
    docs = [(i, text(), lang) for i, lang in enumerate(["de", "en", "it", None, "it", None])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["boundary_model"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.page) for r in got) == [(i, p) for i in range(6) for p in range(2, 13)]
    assert all(r.score is not None for r in got)


def test_sequential_by_rule_and_label(spark):
    """Verdicts by rule and by label give what tables of all verdicts give."""
    rng = random.Random(8)
    rows = [(d, p, [rng.randrange(4)] if rng.random() < 0.5 else None, None) for d in range(6) for p in range(1, 30 + d)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, rests array<int>, text string").repartition(3)
    sizes = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    pairs = [(d, first, p, True) for d, p, rests, _ in rows for first in range(1, p) if rests and first % 4 in rests]
    table = spark.createDataFrame(pairs, "doc_id long, first int, page int, is_new boolean")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(Q.accumulated_by_rule(pages, 4)) == order(Q.accumulated_starts(sizes, table))
    labels, now = [], 0
    for d, p, *_ in rows:
        now += rng.random() < 0.3
        labels.append((d, p, now))
    labelled = spark.createDataFrame(labels, "doc_id long, page int, label int").repartition(3)
    probes = [(d, f, p, True) for d, f, x in labels for e, p, y in labels if d == e and p > f and x != y]
    cuts = spark.createDataFrame([(1, 7), (1, 12), (3, 2), (3, 900)], "doc_id long, start int")
    asked = spark.createDataFrame(probes, "doc_id long, first int, page int, is_new boolean")
    assert order(Q.probed_by_label(labelled, cuts)) == order(Q.probed_starts(sizes, asked, None, cuts))
    assert Q.accumulated_by_rule(pages.limit(0), 4).count() == 0 and Q.probed_by_label(labelled.limit(0)).count() == 0


def test_frontier_equals_each_record_alone(spark):
    """All records at once, with wrong verdicts, confirmations and cuts, give what a search of each part gives."""
    rng = random.Random(12)
    sizes = {d: rng.choice([0, 1, 2, 9, 25]) for d in range(25)}
    new = {(d, s, p) for d, n in sizes.items() for s in range(1, n + 1) for p in range(s + 1, n + 1) if rng.random() < 0.25}
    sure = {(d, p) for d, n in sizes.items() for p in range(1, n + 1) if rng.random() < 0.4}
    cuts = {(d, p) for d, n in sizes.items() for p in (1, 4, 12, n, n + 3) if rng.random() < 0.5}
    verdicts = spark.createDataFrame([(*x, True) for x in new], "doc_id long, start long, ask long, is_new boolean")
    ask = lambda q, small: q.join(verdicts, ["doc_id", "start", "ask"], "left")
    frame = spark.createDataFrame(list(sizes.items()), "doc_id long, n long")
    for confirm in (True, False):
        got = Q.frontier_starts(
            frame, ask, spark.createDataFrame(list(sure), "doc_id long, page long") if confirm else None, spark.createDataFrame(list(cuts), "doc_id long, start long")
        )
        want = set()
        for d, n in sizes.items():
            bounds = [1, *sorted({p for e, p in cuts if e == d and 1 < p <= n}), n + 1]
            for low, after in zip(bounds, bounds[1:]):
                known = {p for e, p in sure if e == d} if confirm else None
                want |= {(d, s) for s in search(lambda s, p: (d, s, p) in new, known, low, after - 1)} if n else set()  # noqa: B023
        assert {(r.doc_id, r.start) for r in got.collect()} == want
