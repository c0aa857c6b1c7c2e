"""The pipeline on the smallest tables, stage by stage against plain Python."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from quirewise.llm import bpe, mixing, quality, secrets
from quirewise.llm import oracle_sql, queries

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == columns
    before, after = kept["quality"]
    points = np.array([quality.statistics(r.text.encode()) for r in before.values()])
    assert set(after) == {i for i, s in zip(before, model.scores(points), strict=True) if s >= quality.THRESHOLD}
    before, after = kept["near_copies"]
    ids = sorted(before)
    # The rule of the stage: rows link at a five-word Jaccard similarity of 0.8.
    sets = []
    for i in ids:
        w = re.findall(r"[^ \t-\r]+", (before[i].text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = {i: i for i in ids}
    for a in range(len(ids)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low = min(group[ids[a]], group[ids[b]])
                old = {group[ids[a]], group[ids[b]]}
                group = {k: low if v in old else v for k, v in group.items()}
    gone = {i for i in ids if group[i] != i}
    assert set(after) == set(ids) - gone and gone
    before, after = kept["secrets"]
    assert set(after) == set(before)
    for i, r in after.items():
        assert not secrets.base_spans(r.text), r.text
        assert r.text == before[i].text or secrets.base_spans(before[i].text) and r.n_chars == len(r.text)
    before, after = kept["mixing"]
    chosen = mixing.probabilities(spark.read.parquet(str(tmp_path / "secrets")), share=corpus_pipeline.MIX_SHARE).where("selected")
    assert set(after) == {r.doc_id for r in chosen.collect()}
    before, after = kept["tokens"]
    codec = bpe.codec(bpe.vocabulary(bpe.default_path()))
    assert all(r.ids == codec.encode(before[i].text).tolist() and r.n_tokens == len(r.ids) for i, r in after.items())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_registration():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    from oracle import assert_equal, connect

    assert_equal(queries()[name](spark, SF), connect(SF), oracle_sql()[name])
