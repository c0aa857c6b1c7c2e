"""Catalog, summaries, segmentation errors and fuzzy titles on small tables: nulls, ties, repeats, empty ones."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quirewise.operators import catalog, classify, diagnose, jobs, summaries


def test_fuzzy_category_against_all_exemplars(spark):
    rng = random.Random(5)
    words = ["report", "supplemental", "progress", "letter", "therapy", "record", "index", "request", "note"]
    exemplars = [(i, f"c{i % 7}", " ".join(rng.choices(words, k=3)).title()) for i in range(25)]
    titles = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", "!", " 12"])) for i in range(120)] + [(500, None), (501, ""), (502, exemplars[3][2]), (502, exemplars[3][2])]
    key = lambda t: re.sub(r"[^a-zA-Z0-9\s]", "", "Unknown" if t is None else t).strip().lower()
    expected = []
    for i, title in titles:
        best, group = 0, "100"
        for _, category, example in exemplars:
            ratio = SequenceMatcher(None, key(title), key(example)).ratio()
            if ratio > best and ratio >= 0.65:
                best, group = ratio, category
        expected.append((i, group))
    frame, board = spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame(exemplars, "place int, category string, title string")
    got = classify.fuzzy_category(frame, board, "id").collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len({g for _, g in expected}) > 4
    assert {r.category for r in classify.fuzzy_category(frame, board.limit(0), "id").collect()} == {"100"}
    assert classify.fuzzy_category(frame.limit(0), board, "id").count() == 0


def test_nearest_category_limits(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, embedding array<double>")
    board = spark.createDataFrame([(3, [1.0, 1.0]), (2, [1.0, 0.0])], "category int, vector array<double>")
    assert sorted(map(tuple, classify.nearest_category(vectors, board, "id").collect())) == [(1, 2, 1.0), (1, 2, 1.0), (2, 2, 0.0)]
    assert classify.nearest_category(vectors, board.limit(0), "id").count() == 0


def test_catalog(spark):
    shape = "id string, name string, active boolean, auto_assign boolean, summarize boolean"
    stored = spark.createDataFrame([("10", "j", True, True, False), ("9", "i", True, False, True), ("2", "b", False, True, True)], shape)
    built = spark.createDataFrame([("1", "a", True, True, True)], shape)
    ids = lambda df: [r.id for r in df.orderBy(*catalog.by_number()).collect()]
    assert ids(catalog.categories(stored, built)) == ["2", "9", "10"]
    assert ids(catalog.categories(stored, built, active_only=True)) == ["9", "10"]
    assert ids(catalog.categories(stored, built, auto_assign=True)) == ["10"]
    assert ids(catalog.categories(stored.limit(0), built)) == ["1"] and ids(catalog.categories(stored.limit(0), built.limit(0))) == []
    rows = spark.createDataFrame([("10",), ("77",), (None,)], "category string")
    assert {r.category: r.include for r in catalog.include_default(rows, stored).collect()} == {"10": False, "77": True, None: True}
    blocks = {r.c: r.b for r in spark.createDataFrame([("9",), ("13",), ("4",), ("999",), (None,)], "c string").withColumn("b", catalog.preamble_blocks(F.col("c"))).collect()}
    assert "deposition" in blocks["9"] and "one_paragraph" not in blocks["9"] and "pain" not in blocks["9"]
    assert {"pain", "embedded_review"} <= set(blocks["13"]) and "verdict" not in blocks["13"]
    assert not {"pain", "verdict", "embedded_review"} & set(blocks["4"])
    assert blocks["999"] == blocks[None] and {"pain", "verdict", "embedded_review", "one_paragraph"} <= set(blocks[None])


def test_summaries(spark):
    rows = "id long, start int, end int, category string, date string, injury_date string, flag string, title string, text string, unreadable array<int>"
    data = [
        (1, 1, 2, "1", "d", "-", "", "old", "some text", None),
        (2, 3, 4, "3", "d", "01/02/24", "x", None, "some text", [4, 3]),
        (3, 5, 5, "9", "d", None, None, "old", "  ", [5]),
        (4, 6, 6, "9", "d", "-", "", "old", None, None),
        (5, 7, 8, "9", "d", "-", "", "old", "text", []),
    ]
    replies = "id long, body string, failed boolean, fallback_body string, made_title string, fixed string, fixed_title string, issues array<string>, audit_failed boolean"
    said = [
        (1, "**A**: b", False, None, "Made", "plain", "Fixed", ["capitalization"], False),
        (2, None, True, "short", "t" * 300, "better", None, ["unsupported"], False),
        (5, "one\ntwo\nOn pages 1 to 2", False, None, "Made", "one two", "Made", ["unsupported"], None),
    ]
    got = {r.id: r for r in summaries.summarise(spark.createDataFrame(data, rows), spark.createDataFrame(said, replies), ["id"], "large", "small").collect()}
    assert (got[1].title, got[1].text, got[1].verified, got[1].verified_text, got[1].verified_title) == ("Made (Pages 1-2)", "**A**: b", True, None, "Fixed (Pages 1-2)")
    note = "Unintelligible: the text recognizer could not read pages 3 and 4 of this document, so that content is not covered by this summary."
    assert got[2].title == "[ManualCheck] - [Diagnostic Study] (Pages 3-4)" and got[2].text == f"**DOI**: 01/02/24. short {note}"
    assert got[2].verified_text == f"**DOI**: 01/02/24. better {note}" and (got[2].model, got[2].fallback_from) == ("small", "large")
    assert got[3].text == "Unintelligible: the text recognizer could not read page 5 of this document, so there was no text to summarize." and got[3].notice_only
    assert got[4].text == "There was no text to summarize." and got[4].model is None and not got[4].verified
    assert not got[5].verified and got[5].verified_text is None and got[5].model == "large"


def test_start_errors(spark):
    starts = lambda *x: spark.createDataFrame([(1, s) for s in x], "doc_id long, start int")
    spans = spark.createDataFrame([(1, 1, 9), (1, 10, 19), (1, 30, 40)], "doc_id long, start int, end int")
    got = diagnose.start_errors(starts(1, 5, 5, 12, 20, 25, 31), starts(1, 10, 30, 50), spans, starts(20, 39))
    assert sorted((r.start, r.kind) for r in got.collect()) == [(5, "over_split"), (10, "missed_near"), (12, "near"), (20, "seam"), (25, "unlabeled"), (30, "missed_near"), (31, "near"), (50, "missed_hard")]
    assert {(r.start, r.end) for r in diagnose.severed(spans, starts(20, 39, 10)).collect()} == {(30, 40)}
    assert diagnose.start_errors(starts(1).limit(0), starts(1).limit(0), spans, starts(20)).count() == 0
    rows = spark.createDataFrame([(1, 0, 2, 4), (1, 0, 3, 5), (1, 0, 8, 9)], "doc_id long, k int, start int, end int")
    chunks = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 11, 14)], "doc_id long, k int, first int, last int")
    assert {(r.k, r.gaps, r.overlaps) for r in diagnose.chunk_coverage(rows, chunks).collect()} == {(0, 1 + 2 + 1, 2), (1, 4, 0)}
    ranked = spark.createDataFrame([("a", 0.9, 0), ("a", 0.8, 1), ("a", 0.8, 0), ("a", 0.1, 1), ("b", 0.5, 0)], "record string, score double, label int")
    assert sorted((r.record, r.hits, r.flagged, r.precision) for r in diagnose.precision_at_recall(ranked).collect()) == [("a", 1, 3, pytest.approx(1 / 3)), ("b", 0, 1, 0.0)]


def test_progress_and_cancellation(spark):
    reports = [(1, 0, "a", 0.0), (1, 1, "a", 0.5), (1, 2, "a", 1.2), (1, 3, "b", 1.3), (1, 4, "b", 2.2), (1, 5, "a", 2.25), (2, 0, "a", 5.0), (None, 0, "a", 1.0)]
    frame = spark.createDataFrame(reports, "job long, seq int, stage string, t double")
    got = sorted((str(r.job), r.seq) for r in jobs.progress_writes(frame, "job", ["seq"], 1.0).collect())
    assert got == [("1", 0), ("1", 2), ("1", 3), ("1", 5), ("2", 0), ("None", 0)]
    events = [(1, 0.0, "tick"), (1, 1.0, "request"), (1, 2.0, "tick"), (1, 3.0, "clear"), (1, 4.0, "tick"), (1, 5.0, "request"), (1, 16.0, "tick")]
    ticks = jobs.cancelled(spark.createDataFrame(events, "job long, t double, kind string"), "job", ["t"], 10.0)
    assert {r.t: r.cancelled for r in ticks.collect()} == {0.0: False, 2.0: True, 4.0: False, 16.0: False}
