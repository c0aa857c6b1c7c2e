"""Date postings, violation reports, store copies and written reports."""

from __future__ import annotations

import random
import re

import pytest

from quirewise.functions.dates import MONTHS
from quirewise.operators import audits as A
from quirewise.operators import contracts as C
from quirewise.operators import jobs as J
from quirewise.operators import reports as R
from quirewise.operators import store as M


def plain_bucket(date, start, end, summarized, pages):
    """The rule on whole texts, by patterns."""
    part = (date or "").split("/")
    if len(part) != 3 or not all(p.isdigit() for p in part) or len(part[2]) != 4 or not (1 <= int(part[0]) <= 12 and 1 <= int(part[1]) <= 31):
        return "no_date_to_check"
    m, d, y = int(part[0]), int(part[1]), part[2]
    sep, year = r"\s?[/.-]\s?", f"({y}|{y[2:]})"
    loose = re.compile(rf"(^|[^0-9])0?{m}{sep}0?{d}{sep}{year}([^0-9]|$)")
    spelled = re.compile(rf"{MONTHS[m - 1]}\s+0?{d},?\s+{y}", re.I)
    month = re.compile(rf"(^|[^0-9])0?{m}{sep}[0-9]{{1,2}}{sep}{year}([^0-9]|$)")
    hit = lambda low, high: any(loose.search(t or "") or spelled.search(t or "") for p, t in pages.items() if low <= p <= high)
    if hit(start, end):
        return "in_row"
    if hit(start - 2, end + 2):
        return "within_2_pages"
    if hit(0, 10**9):
        return "elsewhere_in_doc"
    if not summarized:
        return "wrong_but_never_shipped"
    return "day_differs" if any(month.search(t or "") for p, t in pages.items() if start <= p <= end) else "absent"


def test_date_in_source(spark):
    rng = random.Random(7)
    forms = ["{m}/{d}/{y}", "{m:02d}-{d:02d}-{s}", "{m} . {d} .{y}", "{n} {d}, {y}", "{n}  0{d} {y}", "x{m}/{d}/{y}9", "00{m}/{d}/{y}", "{m}/{d}/{s}/{d}/{s}", "ref {m}/{d}"]
    date = lambda: dict(m=rng.randint(1, 13), d=rng.randint(0, 32), y=2000 + rng.randint(0, 3))
    spell = lambda f, x: f.format(**x, s=f"{x['y'] % 100:02d}", n=MONTHS[(x["m"] - 1) % 12].upper())
    pages, rows = {}, []
    for doc in range(30):
        used = [date() for _ in range(4)]
        for p in range(1, 12):
            pages[doc, p] = None if rng.random() < 0.1 else " and ".join(spell(rng.choice(forms), rng.choice(used)) for _ in range(rng.randint(0, 3)))
        for k in range(12):
            x, start = rng.choice(used) if rng.random() < 0.8 else date(), rng.randint(1, 11)
            text = rng.choice(["{m:02d}/{d:02d}/{y}", "{m}/{d}/{y}"]).format(**x) if k else rng.choice([None, "-", "1/2", "13/1/20x1"])
            rows.append((doc, start, min(11, start + rng.randint(0, 2)), text, rng.random() < 0.7, k))
    frame = spark.createDataFrame(rows, "doc_id long, start int, end int, date string, summarized boolean, k int").repartition(3)
    texts = spark.createDataFrame([(d, p, t) for (d, p), t in pages.items()], "doc_id long, page int, text string")
    got = {(r.doc_id, r.k): r.bucket for r in A.date_in_source(frame, texts).collect()}
    want = {(d, k): plain_bucket(t, s, e, z, {p: x for (n, p), x in pages.items() if n == d}) for d, s, e, t, z, k in rows}
    assert got == want and len(set(want.values())) == 7
    assert A.date_in_source(frame.limit(0), texts).count() == 0
    assert {r.bucket for r in A.date_in_source(frame, texts.limit(0)).collect()} <= {"no_date_to_check", "wrong_but_never_shipped", "absent"}


def test_violations(spark):
    rows = [
        (1, 3, '{"i": 2, "c": "a"}'), (2, 3, '{"i": 4, "c": "z"}'), (3, 3, "{"), (4, 3, "[]"), (5, 3, '{"i": "2"}'), (6, 3, None),
        (7, 3, '{"i": null, "c": "a", "t": [1]}'), (8, 3, '{"i": 1.5, "c": "b", "t": "x"}'), (9, 3, "{}"),
    ]
    fields = [C.Field("i", "integer", low=1, high="n"), C.Field("c", "string", among=("a", "b")), C.Field("t", "array", required=False)]
    got = {(r.id, r.field, r.problem) for r in C.violations(spark.createDataFrame(rows, "id int, n int, reply string"), "reply", fields).collect()}
    assert got == {
        (2, "i", "out of range"), (2, "c", "not among the values"), (3, None, "not json"), (4, None, "not an object"), (5, "i", "wrong type"), (5, "c", "missing"),
        (6, None, "not json"), (7, "i", "missing"), (8, "i", "wrong type"), (8, "t", "wrong type"), (9, "i", "missing"), (9, "c", "missing"),
    }
    many = spark.createDataFrame([(1, '[{"i": 1}, {"i": "x"}, {}]'), (2, '{"i": 1}'), (3, "[]")], "id int, reply string")
    got = {(r.id, r["at"], r.problem) for r in C.violations(many, "reply", [C.Field("i", "integer")], many=True).collect()}
    assert got == {(1, 1, "wrong type"), (1, 2, "missing"), (2, None, "not an array")}


def test_store_copy(spark):
    old = {
        "c": spark.createDataFrame([(1, 10, 5), (2, 99, 5), (3, None, 5), (3, None, 5)], "c_id long, c_bkey long, c_x int"),
        "b": spark.createDataFrame([(10, 1), (11, 7), (None, 1)], "b_bkey long, b_akey long"),
        "a": spark.createDataFrame([(1,), (2,)], "a_akey long"),
    }
    keys = {"a": "a_akey", "b": "b_bkey"}
    links = M.references(old, keys, share=0.4)
    assert {(x.table, x.column, x.parent) for x in links} == {("c", "c_bkey", "b"), ("b", "b_akey", "a")}
    done = M.copy_store(old, keys, {"c": ["c_bkey", "c_id", "new"], "b": ["b_bkey"], "z": ["q"], "a": ["a_akey"]}, links)
    assert [(x.name, x.copied, x.orphans, x.next_number) for x in done] == [("a", 2, 0, 3), ("b", 2, 1, 11), ("c", 3, 1, None)]
    assert sorted(map(str, done[2].rows.collect())) == sorted(["Row(c_bkey=10, c_id=1)", *["Row(c_bkey=None, c_id=3)"] * 2])
    with pytest.raises(ValueError):
        M.parents_first(["a", "b"], [M.Reference("a", "x", "b"), M.Reference("b", "y", "a")])
    assert M.copy_store({k: v.limit(0) for k, v in old.items()}, keys, {"a": ["a_akey"], "b": ["b_bkey"]})[0].next_number == 1


def test_reports_are_one_ordered_file_each(spark, tmp_path):
    heads = spark.createDataFrame([("a b", "N\nM", "born", "", "Intro."), ("c", None, None, "QME", None)], "k string, name string, born string, kind string, intro string")
    entries = [("a b", "02/03/2020", "T2", "x\ny", 1), ("a b", "-", "T0", None, 9), ("a b", "1/2/2020", "T1", "z", 2), ("a b", "02/03/2020", "T3", "w", 0)]
    frame = spark.createDataFrame(entries, "k string, date string, title string, text string, n long").repartition(4)
    path = str(tmp_path / "reports")
    for _ in range(2):  # written again without doubles
        R.write_reports(R.report_lines(heads, frame, "k", "n"), "k", path)
    lines = R.read_reports(spark, path).orderBy("record", "n").collect()
    assert len({r.file for r in lines}) == 2
    first = [r.line for r in lines if r.record.startswith("a")]
    assert first == [
        "RE: N M", "born", " ", R.REVIEW_TITLE, "Intro.", R.SUMMARY_INTRO, "-\tT0: ", "1/2/2020\tT1: z", "02/03/2020\tT3: w", "02/03/2020\tT2: x y", R.CONCLUSION,
    ]
    assert [r.line for r in lines if r.record == "c"][:3] == ["RE: ", "", "QME"]


def test_reports_are_written_by_tasks_and_read_in_one_pass(spark, tmp_path, monkeypatch):
    """Names and lines are those of Spark's own writer, but no file costs a process of its own, and few tasks read all of them."""
    keys = ["a/b", "x=1 {[^]}", "", None, "%2F", "é'\"\\", *map(str, range(300))]
    lines = spark.createDataFrame([(k, i, "x\ry" if i else None) for k in keys for i in range(3)], "k string, at int, line string").selectExpr("k", "0 AS part", "at", "line").repartition(5)
    R.write_reports(lines, "k", f"file://{tmp_path}/own")
    assert not list((tmp_path / "own").rglob("*.crc")) and [p.name for p in tmp_path.iterdir()] == ["own"]
    monkeypatch.setattr(R, "_plain_folder", lambda *x: None)
    R.write_reports(lines, "k", str(tmp_path / "spark"))
    read = [R.read_reports(spark, str(tmp_path / name)) for name in ("own", "spark")]
    folders = [{str(p.parent.relative_to(tmp_path / name)) for p in (tmp_path / name).rglob("*.txt")} for name in ("own", "spark")]
    assert folders[0] == folders[1] and len(folders[0]) == len(keys) - 1
    own, spark_ = (sorted((r.record, r.n_files, r.n, r.line) for r in df.collect()) for df in read)
    assert own == spark_ and len(own) == 3 * len(keys) and {r[1] for r in own} == {1}
    assert read[0].select("file").rdd.getNumPartitions() <= R.READERS


def test_reports_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no status of a report's file; the lines are those of Spark's reader."""
    keys = ["a/b", "", None, "%2F", "é", *map(str, range(40))]
    lines = spark.createDataFrame([(k, i, ["x\ry", None, "", "z"][i]) for k in keys for i in range(4)], "k string, at int, line string").selectExpr("k", "0 AS part", "at", "line")
    path = str(tmp_path / "own")
    R.write_reports(lines, "k", path)
    read = R.read_reports(spark, path)
    assert not read.inputFiles() and read.rdd.getNumPartitions() <= R.READERS
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(R, "_plain_folder", lambda *x: None)
        spark_ = R.read_reports(spark, path)
    assert read.dtypes == spark_.dtypes
    own, other = (sorted((r.record, r.n_files, r.n, r.line) for r in df.collect()) for df in (read, spark_))
    assert own == other and len(own) == 4 * len(keys)


def test_attempt_statistics(spark):
    rows = [("a", "accepted", 500, 0.0), ("a", "exhausted", 0, 60.0), ("a", "rate_limited", 1500, 90.0), ("b", "accepted", None, 120.0)]
    got = {r.m: r for r in J.attempt_statistics(spark.createDataFrame(rows, "m string, o string, wait_ms long, t double"), "m", "o").collect()}
    assert (got["a"].attempts, got["a"].reject_percent, got["a"].wait_s, got["a"].accepted_a_minute) == (2, 50.0, 2.0, 0.5)
    assert (got[None].attempts, got[None].accepted, got[None].accepted_a_minute) == (3, 2, 1.0) and got["b"].wait_s == 0
