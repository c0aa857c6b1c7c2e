"""Queries and their SQL on rows where they once differed."""

from __future__ import annotations

import datetime

from oracle import assert_equal, connect

from quirewise.queries import ORACLES, QUERIES


def agree(spark, folder, name):
    made = QUERIES[name](spark, str(folder))
    assert_equal(made, connect(str(folder)), ORACLES[name])
    return made.collect()


def test_header_rates_of_empty_windows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, 1, "view", 90.0, ""), (2, at, 1, "view", 0.0, ""), (3, at, 2, "view", -4.0, ""), (4, at, 3, "view", None, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/e")
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert [(r.user_id, r.rate) for r in agree(spark, tmp_path, "header_rates")] == [(1, 0.04)]


def test_counter_offset_ties(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    # Of user 1, offsets 1 and 4 are read twice each, and first at the same place.
    rows = [(i, at, 1, "view", 1.0, "") for i in (0, 78, 54, 132, 4, 6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/e")
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert len(agree(spark, tmp_path, "counter_offset")) == 1
    from quirewise.operators import pages as P

    for turned in (1, -1):
        tied = [(1, 1, 5), (1, 1, 5), (1, 1, 2), (1, 1, 2)][::turned]
        assert P.counter_offset(spark.createDataFrame(tied, "k long, i long, printed long").coalesce(1), "k", 6).first().offset == 1


def test_transition_numbers_of_other_counters(spark, tmp_path):
    texts = ["a\nPAGE 1/3 x\nsee page  2 of 3\n" + "y" * 1988 + "\npage\x0b7 of 9999", "x" * 1990 + "\n" + "z" * 1982 + "\n" + "z" * 1983]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert {r.pagenum for r in agree(spark, tmp_path, "transition_numbers")} == {0, 1, -1}


def test_transition_numbers_of_late_counters(spark, tmp_path):
    # 5998 % 3 = 1: the second page's counter, 3 of 3, stands behind 2000 characters; so does the third's own, 1 of 9.
    texts = ["a\n" + "y" * 5998 + "\n" + "z" * 4000 + " page 1 of 9 " + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert {r.page: r.pagenum for r in agree(spark, tmp_path, "transition_numbers")} == {2: -1, 3: 1}
