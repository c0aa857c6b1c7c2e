"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text is described by transformed statistics (shares as square roots, sizes
as logarithms).  Both classes get a mean and a covariance, shrunk towards its own
diagonal and the pooled covariance; the score is the logistic of the difference
of the Mahalanobis log-densities, computed with the covariances' Cholesky
factors, which are kept with the model.

The model is fitted on at most ``fit_rows`` labelled rows (those of the smallest
hash), outside the held-out fold; its moments are sums that Spark adds up.

Rows: a null text counts as empty and gets a score like any other; labels other
than 0 and 1 and null doc_ids do not train; repeated labels count each; without
labels of both classes every score is 1.0; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.columns import column, extended

from .common import map_batches, read, record_batch, text_or_empty

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.7
#: Weights of the class's own diagonal and of the pooled covariance.
TO_DIAGONAL, TO_POOLED = 0.1, 0.1
#: The log-density difference is divided by this: the statistics are not independent draws.
TEMPERATURE = 4.0

FEATURES = (
    "log_bytes", "log_words", "log_word_bytes", "upper", "digits", "stops", "signs", "bangs", "bars",
    "beyond_ascii", "distinct_words", "top_word", "repeated_lines", "log_line_words", "ended_words", "odd_words",
    "echoed_words",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
for _i, _signs in enumerate((b".,;:'\"-()?", b"#$%&*@^~=+<>/\\{}[]_", b"!", b"|", b" \t\n\r"), 4):
    _CLASS[list(_signs)] = _i
_CLASS[128:] = 9
_PLAIN = bytes(b for b in range(256) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text, in the order of FEATURES."""
    if not text.strip():
        return [0.0] * len(FEATURES)
    n = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)
    words = text.split()
    lines = text.split(b"\n")
    times = Counter(words)
    letters = max(1, n[1] + n[2])
    solid = max(1, len(text) - n[8])
    root = lambda a, b: float(np.sqrt(a / b))
    odd = sum(k for w, k in times.items() if len(w.strip(_PLAIN)) + 1 < len(w))
    ended = sum(k for w, k in times.items() if w[-1:] in b"!$%&*#|")
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(np.log1p(solid / len(words))),
        root(n[1], letters),
        root(n[3], solid),
        root(n[4], solid),
        root(n[5], solid),
        root(n[6], solid),
        root(n[7], solid),
        root(n[9], solid),
        root(len(times), len(words)),
        root(max(times.values()) - 1, len(words)),
        root(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(len(words) / len(lines))),
        root(ended, len(words)),
        root(odd, len(words)),
        root(sum(map(operator.eq, words, words[1:])), len(words)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with their inverse Cholesky factors."""

    means: np.ndarray
    factors: np.ndarray
    offset: float

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Probability-like scores of class 1."""
        squares = [
            np.square((points - mean) @ factor.T).sum(axis=1)
            for mean, factor in zip(self.means, self.factors, strict=True)
        ]
        margin = (self.offset + 0.5 * (squares[0] - squares[1])) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def held_out(doc_id: Column) -> Column:
    """The fold that never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant | None:
    """The discriminant of the training fold, or None without rows of both classes."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_quality")
        .limit(fit_rows)
    )
    rows = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(chosen), "doc_id")
    d = len(FEATURES)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = np.array([statistics(t.encode("utf-8", "surrogatepass")) for t in batch.column(0).to_pylist()])
        columns = [pa.array(points[:, i]) for i in range(d)]
        return pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=[*(f"f{i}" for i in range(d)), "_quality"])

    described = map_batches(
        rows.select("_text", F.col("_quality").cast("int").alias("_quality")),
        per_batch,
        ", ".join(f"f{i} double" for i in range(d)) + ", _quality int",
    )
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(d)]
    squares = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {r["_quality"]: r for r in described.groupBy("_quality").agg(F.count("*").alias("n"), *sums, *squares).collect()}
    if set(moments) != {0, 1}:
        return None
    counts = np.array([moments[k]["n"] for k in (0, 1)], float)
    means = np.array([[moments[k][f"s{i}"] for i in range(d)] for k in (0, 1)]) / counts[:, None]
    second = np.array(
        [[[moments[k][f"q{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)] for k in (0, 1)]
    )
    return discriminant(counts, means, second / counts[:, None, None] - means[:, :, None] * means[:, None, :])


def discriminant(counts: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> Discriminant:
    """Shrink the covariances and factor them."""
    pooled = np.tensordot(counts / counts.sum(), covariances, 1)
    # No statistic is taken to vary less than a fiftieth of what it does overall.
    spread = np.diag(pooled) + np.average(np.square(means - np.average(means, 0, counts)), 0, counts)
    floor = np.diag(np.maximum(spread / 50, 1e-4))
    factors, logs = [], []
    for own in covariances:
        shrunk = (
            (1 - TO_DIAGONAL - TO_POOLED) * own + TO_DIAGONAL * np.diag(np.diag(own)) + TO_POOLED * pooled + floor
        )
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        logs.append(2 * np.log(np.diag(factor)).sum())
    offset = np.log(counts[1] / counts[0]) + 0.5 * (logs[0] - logs[1])
    return Discriminant(means, np.array(factors), float(offset))


def score(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """All columns of ``docs``, then ``score`` and ``predicted`` (1 from THRESHOLD on).

    Columns of these names in the input, in any case, are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended([docs.schema[c] for c in kept], score=T.DoubleType(), predicted=T.IntegerType())

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        points = np.array([statistics((t or "").encode("utf-8", "surrogatepass")) for t in texts])
        scores = np.ones(len(texts)) if shared.value is None else shared.value.scores(points)
        made = record_batch(s=(scores, pa.float64()), p=((scores >= THRESHOLD).astype(np.int32), pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*kept, "score", "predicted"])

    return map_batches(docs.select(*[column(c) for c in kept]), per_batch, schema)


def keep(docs: DataFrame, model: Discriminant | None, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value is None:
            return batch
        points = np.array([statistics((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()])
        return batch.filter(pa.array(shared.value.scores(points) >= least))

    return map_batches(docs, per_batch, extended(docs.schema))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of the whole documents table."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
