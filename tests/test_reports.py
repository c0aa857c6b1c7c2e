"""Edge cases of bundles, notices and readers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirewise.operators import reports as R
from quirewise.sources import tables as T


def test_bundles_need_a_category(spark):
    rows = spark.createDataFrame([(1, 1, 9, "3", 1)], "doc_id long, start int, end int, category string, idx int")
    sizes = spark.createDataFrame([(1, 3)], "doc_id long, n int")
    assert [r.page for r in R.bundle_pages(rows, sizes, ["3"]).orderBy("place").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        R.bundle_pages(rows, sizes, [])


def test_notices_and_backfill(spark):
    rows = spark.createDataFrame(
        [(1, True, None, None, None, None), (2, True, "m", None, None, None), (3, True, None, "", None, None), (4, None, None, None, None, None)],
        "id long, unreadable boolean, model string, edited_title string, edited_text string, edited_date string",
    )
    assert [r.id for r in R.retryable_notices(rows).collect()] == [1]
    assert R.all_or_abort(rows, F.col("id") > 2).count() == 2
    assert R.all_or_abort(rows, F.col("id") > 9).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "cache.jsonl").write_text('{"page": 1, "text": "a"}\nnot json\n{"page": 3, "text": "c"}\n{"page": 3, "text": "d"}\n')
    cache = str(tmp_path / "cache.jsonl")
    assert [tuple(r) for r in T.read_ocr_cache(spark, cache).orderBy("page").collect()] == [(1, "a"), (2, ""), (3, "d")]
    assert sorted(r.page for r in T.done_pages(spark, cache).collect()) == [1, 3]
    (tmp_path / "labels.csv").write_text("start,end\n1,3\nx,4\n4,99\n")
    assert sorted(map(tuple, T.read_labels(spark, str(tmp_path / "labels.csv"), 10).collect())) == [(1, 3), (4, 10)]
    (tmp_path / "map.csv").write_text("1,2,3,Title,-,-\n1,2\na,2,3,T,-,-\n")
    assert [(r.start, r.end, r.title) for r in T.read_page_map(spark, str(tmp_path / "map.csv")).collect()] == [(1, 2, "Title")]
    (tmp_path / "one.txt").write_bytes(b"page one\fpage two\f")
    files = spark.read.format("binaryFile").load(str(tmp_path / "one.txt"))
    assert T.page_count(files).first().n_pages == 2


def test_replies(spark):
    reply = '```json\n[{"s": 1, "e": 2, "t": "A"}, {"s": "x", "e": 3}, {"s": 3, "e": 4, "title": "B", "d": "01/01/2020"}]\n```'
    rows = T.parse_segments(spark.createDataFrame([(1, reply), (2, "nonsense")], "doc_id long, reply string")).orderBy("at").collect()
    assert [(r.start, r.end, r.title, r.date) for r in rows] == [(1, 2, "A", "-"), (3, 4, "B", "01/01/2020")]


def test_index_links(spark):
    html = '<a href="/doc?page=0">a</a><a href="x/p7">b</a>'
    rows = T.start_pages(spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (1, 8)]


def test_human_dates(spark):
    reports = spark.createDataFrame([(1, "1/2/20\tSeen\nno date\n01/02/2020\tagain\n13/1/20\tbad")], "doc_id long, text string")
    assert [tuple(r) for r in T.human_entry_dates(reports).collect()] == [(1, "01/02/2020")]
