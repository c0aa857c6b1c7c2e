"""What operators hold, search and shuffle."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
from oracle import assert_equal
from pyspark.sql import functions as F
from test_dedup import shuffled_rows

from quirewise.functions import dates as D
from quirewise.operators import caps, learn, sequential
from quirewise.queries import ORACLES, QUERIES


def test_unknown_terms_are_not_shuffled(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(200)) + " shared words") for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    before = shuffled_rows(spark)
    got = learn.tfidf(rows.where("doc_id < 4"), rows, "doc_id", "text", most_terms=50).collect()
    assert {r.term for r in got} == {"shared", "words", "shared words"} and len(got) == 120
    assert shuffled_rows(spark) - before < 4000


def test_caps_are_repaired_by_slices(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(caps, "map_arrow", lambda rows, run, schema: kept.append(run))
    caps.repair_caps(spark.createDataFrame([("x",)], "text string"), "text")
    batch = pa.RecordBatch.from_arrays([pa.array(["THE WHOLE TEXT. It"] * 999)], names=["text"])
    made = list(kept[0](iter([batch])))
    assert max(b.num_rows for b in made) <= 200 and [t for b in made for t in b.column(0).to_pylist()] == [caps.repair("THE WHOLE TEXT. It")] * 999


def test_a_label_is_searched_once(spark):
    row = spark.createDataFrame([("Date of exam: 1/02/2020 DOS | 3-4-21 date seen 12/31/99",)], "t string").select(D.labelled_dates(F.col("t"), "encounter_date").alias("d"))
    assert row.first().d == ["01/02/2020", "03/04/2021", "12/31/2099"]
    assert row._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= len(D.DATE_LABELS["encounter_date"])


def test_rounds_of_questions_shuffle_blocks_of_pages(spark, tmp_path, monkeypatch):
    """Each round meets blocks of pages, not all pages; spans and confirmations pass over the blocks' ends."""
    rng = random.Random(9)
    text = lambda n: "\n".join("x" * rng.randint(1, 40) for _ in range(n))
    docs = [(i, text(n)) for i, n in enumerate([1, 63, 64, 65, 127, 128, 129, *[300] * 20])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(sequential, "BROADCAST_QUESTIONS", 0)
    before = shuffled_rows(spark)
    got = QUERIES["frontier_starts"](spark, str(tmp_path))
    shuffled = shuffled_rows(spark) - before
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_equal(got, db, ORACLES["frontier_starts"])
    pages = sum(t.count("\n") + 1 for _, t in docs)
    assert shuffled < 2.3 * pages, shuffled / pages
