"""Super-k-mer removal of repeated passages, against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.llm import substrings


def brute(rows, window=substrings.WINDOW):
    """(doc_id, n_words, n_removed, digest) of each row."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def found(df):
    kept = substrings.without_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("d"))
    return Counter(map(tuple, kept.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(1, 6))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    passage, line, thirteen, twelve = text(60), text(14), text(13), text(12)
    out = [(i, text(rng.randint(0, 90))) for i in range(40, 80)]
    out += [(100 + i, f"{text(rng.randint(0, 30))}\n{passage}\t{text(20)}") for i in range(40)]
    out += [(200 + i, f"{text(30)} {line} {text(rng.randint(0, 30))}") for i in range(30)]
    out += [(300 + i, thirteen if i % 2 else twelve) for i in range(10)]
    out += [(400, None), (401, ""), (402, " \n\t\x0b"), (None, passage), (None, passage), (5, passage), (5, passage), (5, text(20) + passage)]
    out += [(500, "a " * 300), (501, "a " * 13 + text(3000)), (-3, "Ünïcödé 日本語 x y " * 20), (502, "Ünïcödé 日本語 x y " * 9)]
    out += [(600 + i, f"{text(3)} {words[0]} {words[1]} {words[2]} {words[3]} {text(12)}") for i in range(60)]
    return out


def test_against_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash")).withColumn("N", F.lit(1))
    assert found(frame.repartition(3)) == brute(rows)


def test_small_units_and_many_buckets(spark, rows, monkeypatch):
    """Windows that meet only in their buckets, strings that are cut by hot pieces, and unequal partitions."""
    monkeypatch.setattr(substrings, "UNIT_BYTES", 700)
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(frame) == brute(rows)


def test_empty_and_null_tables(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == Counter()
    rows = [(None, None), (1, None), (2, None)]
    assert found(spark.createDataFrame(rows, "doc_id int, text string")) == brute(rows)
    assert substrings.without_repeats(spark.createDataFrame(rows, "doc_id int, text string")).schema["doc_id"].dataType.simpleString() == "int"


def test_windows_of_one_hash_are_told_apart():
    words = substrings.Words([b"a b c", b"a b c", b"a b d"])
    same = np.zeros(3, np.uint64)
    assert substrings.smallest_doc(words, words.whole(3), same, np.array([1, 2, 3]), 3).tolist() == [1, 1, 3]


def test_windows_are_named_alike_everywhere():
    """Every window's minimiser depends on its words alone, and strings hold their windows."""
    rng = random.Random(5)
    text = [b"%d" % rng.randrange(30) for _ in range(500)]
    words = substrings.Words([b" ".join(text)])
    at = words.whole(13)
    common = np.sort(words.rolling(4)[:40])
    names = substrings.super_kmers(words, at, words.rolling(13)[at], common, 13, 4)
    for k in range(0, len(at), 37):
        alone = substrings.Words([b" ".join(text[k : k + 13])])
        assert substrings.super_kmers(alone, alone.whole(13), alone.rolling(13), common, 13, 4)[0] == names[k]
    assert len(substrings.runs(at, names)[0]) < len(at) / 3


def test_common_pieces(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(40)) + " one very common line of words") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(0).cast("long")).select("doc_id", "mark", "text")
    got = substrings.common_pieces(frame.repartition(2), 48, 4)
    line = substrings.Words([b"one very common line of words"])
    assert set(line.rolling(4).tolist()) <= set(got.tolist()) and len(got) <= 96
