"""The pipeline's near-copy stage: recall by similarity, and columns of any name through all stages."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirewise.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def planted():
    """Pairs from just below to well above the bound, of 12 to 400 words: appended, cut, edited in places."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    out = []
    for n in (12, 16, 40, 100, 200, 400):
        for share in (0.01, 0.03, 0.06, 0.1, 0.15, 0.19, 0.22, 0.26):
            for kind in ("append", "edit", "both"):
                base = [word() for _ in range(n)]
                other, more = list(base), max(1, round(n * share))
                if kind != "append":
                    for k in rng.sample(range(n), max(1, round(more / 5))):
                        other[k] = word()
                if kind != "edit":
                    other += [word() for _ in range(more)]
                out.append((" ".join(base), " ".join(other)))
    return out


def test_recall_by_similarity(spark, planted):
    """Every pair of at least 0.8 is found and no other, in each band of similarity and at each length."""
    rows = [(2 * i + k, t) for i, pair in enumerate(planted) for k, t in enumerate(pair)]
    bands: dict[float, int] = {}
    expected = set()
    for i, (a, b) in enumerate(planted):
        value = jaccard(shingles(a), shingles(b))
        bands[min(int(value * 20) / 20, 0.95)] = bands.get(min(int(value * 20) / 20, 0.95), 0) + 1
        expected |= {2 * i} if value >= 0.8 else {2 * i, 2 * i + 1}
    assert min(bands.get(x, 0) for x in (0.75, 0.8, 0.85, 0.9, 0.95)) >= 8
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(frame).collect()} == expected


def test_common_shingles_come_last(spark):
    rng = random.Random(32)
    line = "one very common line of nine words in all"
    texts = [(line + " " + " ".join(str(rng.randrange(10**7)) for _ in range(40)),) for _ in range(300)]
    keys, counts = simhash.common_shingles(spark.createDataFrame(texts, "text string").repartition(2), share=0.005)
    ours = set(simhash.shingle_hashes(line.encode()).tolist())
    assert set(keys.tolist()) == ours and (counts == 300).all()
    first = simhash.rare_first(simhash.shingle_hashes(texts[0][0].encode()), (keys, counts), 0.8)
    assert not ours & set(first.tolist()) and len(first) == 45 - 36 + 1


def test_prefixes_always_meet():
    """Two sets of at least that similarity share one of their first shingles, whatever the counts."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.choice(10_000, rng.integers(2, 120), replace=False).astype(np.int64)
        counted = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
        common = counted, rng.integers(2, 9, len(counted))
        a = np.sort(pool[rng.random(len(pool)) < 0.93])
        b = np.sort(pool[rng.random(len(pool)) < 0.93])
        if len(a) and len(b) and jaccard(set(a.tolist()), set(b.tolist())) >= 0.8:
            assert set(simhash.rare_first(a, common, 0.8).tolist()) & set(simhash.rare_first(b, common, 0.8).tolist())


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = rng.integers(-(2**63), 2**63, rng.integers(1, 900))
        a, b = (np.unique(pool[rng.random(len(pool)) < rng.choice([0.3, 0.8, 0.95])]) for _ in range(2))
        apart = simhash.sketches_apart(simhash.wide_sketch(a), simhash.wide_sketch(b))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        if min(len(a), len(b)) > 100 and max(len(a), len(b)) < 1.2 * min(len(a), len(b)) and jaccard(set(a.tolist()), set(b.tolist())) < 0.5:
            assert apart > simhash.most_different(np.array([len(a) + len(b)]), 0.8)[0]


def odd_columns(frame):
    """Columns that schemas written as text, or names compared by case, would break on."""
    made = frame.withColumn("nested", F.struct(F.lit(1).alias("a-b"), F.lit("x").alias("c`d"), F.col("doc_id").alias("e f")))
    for name in ("Score", "TEXT2", "we`ird", "a.b", "Predicted", "_row_", "probability", "n tokens"):
        made = made.withColumn(name, F.lit("mine"))
    return made.withColumn("facts", F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1)))).withColumn("when", F.current_date())


def test_stages_keep_odd_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = odd_columns(spark.read.parquet(f"{sf}/documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = docs.checkpoint()
        row = docs.select(F.col("`we``ird`"), "Score", F.col("`a.b`"), F.col("nested.`a-b`"), F.col("facts")["k"]).first()
        assert tuple(row) == ("mine", "mine", "mine", 1, 1), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_run_on_empty_and_null_tables(spark, tmp_path, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 1
