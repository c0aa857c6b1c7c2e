"""Credentials of a labelled format that stand without their label, found by the query over a whole table."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from quirewise.llm import secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def found_by_query(spark, folder, make, seed, longer=""):
    """(recall, precision) of the method's spans; every second document gets a labelled credential, the others one without its label."""
    rng = random.Random(seed)
    rows, planted = [], {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r.text or ""
        if r.doc_id % 2:
            text += f"\ntoken = \"{make(rng)}\"\n"
        else:
            text += "\nsee "
            key = make(rng)
            planted[r.doc_id] = len(text) + len(longer), len(text) + len(longer) + len(key)
            text += longer + key + " for it\n"
        rows.append((r.doc_id, text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    spans = {}
    for r in secrets.op7_secrets(spark, str(folder)).collect():
        spans[r.doc_id] = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("format:")]
    hits = {i for i, (a, b) in planted.items() if any(s <= a and b <= e for s, e in spans[i])}
    right = sum(any(s < planted[i][1] and planted[i][0] < e for s, e in [x]) for i, own in spans.items() if i in planted for x in own)
    return len(hits) / len(planted), right / max(1, sum(map(len, spans.values())))


@pytest.mark.parametrize(
    ("name", "make"),
    [
        ("prefixed", lambda rng: "sk_" + "".join(rng.choices(UPPER, k=8)) + "-" + "".join(rng.choices(UPPER, k=24))),
        ("parts", lambda rng: "-".join("".join(rng.choices(UPPER, k=n)) for n in (4, 6, 6, 8))),
        ("mixed", lambda rng: "tok." + "".join(rng.choices(UPPER + "abcdefghijklmnopqrstuvwxyz", k=40)) + "="),
    ],
)
def test_unlabelled_credentials(spark, tmp_path, name, make):
    recall, precision = found_by_query(spark, tmp_path, make, 3)
    print(name, "recall", recall, "precision", precision)
    assert recall >= 0.95 and precision >= 0.95
