"""Boundary models: word features on pyspark.ml, and logistic regression that leaves each record out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.columns import extended, map_arrow
from quirewise.operators.graph import checkpoint
from quirewise.session import ship

#: Terms of a vocabulary that are broadcast, at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def weighted_terms(train: DataFrame, column: str, least_documents: int = 2, most_terms: int = 50_000) -> Pipeline:
    """A pipeline of single words and pairs, weighted by rarity; fit it on ``train``."""
    words = RegexTokenizer(inputCol=column, outputCol="_w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="_w", outputCol="_p")
    count = lambda i, o: CountVectorizer(inputCol=i, outputCol=o, minDF=float(least_documents), vocabSize=most_terms)
    stages = [words, pairs, count("_w", "_cw"), count("_p", "_cp"), IDF(inputCol="_cw", outputCol="_iw"), IDF(inputCol="_cp", outputCol="_ip")]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["_iw", "_ip"], outputCol="features")])


def _terms(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, term`` of each word and each pair of words of the texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    split = rows.select(key, words.alias("_w"))
    pairs = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return split.select(key, F.explode(F.concat("_w", pairs)).alias("term"))


def tfidf(train: DataFrame, rows: DataFrame, key: str, column: str, least_documents: int = 2, most_terms: int = 50_000) -> DataFrame:
    """``key, term, weight``: damped counts of words and pairs by their rarity, each text at unit length.

    The vocabulary and the rarities are those of ``train``: of the terms that at
    least ``least_documents`` of its texts have, the ``most_terms`` most frequent
    (of equally frequent ones the first by name).  A text without a known term has
    no rows.  Texts to learn from are dealt by key before their terms are made, and
    of all others only the numbers of known terms are.
    """
    counted = _terms(train.select(key, column).repartition(key), key, column).groupBy(key, "term").agg(F.count("*").alias("n"))
    total = train.agg(F.count("*").alias("_all"))
    common = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= least_documents)
    vocabulary = common.orderBy(F.col("tf").desc(), "term").limit(most_terms).crossJoin(F.broadcast(total))  # one row of totals
    rarity = (F.log((1 + F.col("_all")) / (1.0 + F.col("df"))) + 1).alias("_r")
    known = checkpoint(vocabulary.select("term", rarity, F.monotonically_increasing_id().alias("_t")))
    near = F.broadcast(known) if most_terms <= MOST_BROADCAST else known  # a vocabulary of bounded size
    numbers = _terms(rows, key, column).join(near, "term").select(key, "_t")
    counts = numbers.repartition(key).groupBy(key, "_t").agg(F.count("*").alias("n"))
    weighed = counts.join(near, "_t").select(key, "term", ((1 + F.log("n")) * F.col("_r")).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighed.withColumn("_l", length).select(key, "term", (F.col("_w") / F.col("_l")).alias("weight"))


class Folds(NamedTuple):
    """Of every fold, what its training side adds up to, which is all rows but its own; ``share``: of ones among them."""

    records: list
    centre: np.ndarray
    scale: np.ndarray
    penalty: np.ndarray
    class_weights: np.ndarray
    share: np.ndarray

    @property
    def trained(self) -> np.ndarray:
        """Folds whose other records have both classes."""
        return np.isfinite(self.class_weights).all(1)


def _sums(rows: DataFrame, record: str, features: list[str], label: str) -> DataFrame:
    """``record, n, p`` and the sums and squares of the features of each record's labelled rows."""
    known = F.col(label).isNotNull()
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(f)
    each = []
    for i, f in enumerate(features):
        each += [F.sum(F.when(known, F.col(f))).alias(f"s{i}"), F.sum(F.when(known, F.col(f) * F.col(f))).alias(f"q{i}")]
    return rows.groupBy(record).agg(F.count_if(known).alias("n"), F.count_if(known & (F.col(label) == 1)).alias("p"), *each)


def _folds(rows: DataFrame, record: str, features: list[str], label: str) -> Folds:
    found = _sums(rows, record, features, label).collect()  # one row of a few numbers for each record
    d = len(features)
    n, p = (np.array([float(r[c] or 0) for r in found]) for c in "np")
    s, q = (np.array([[float(r[f"{c}{j}"] or 0) for j in range(d)] for r in found]).reshape(-1, d) for c in "sq")

    def spread(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / np.maximum(n, 1)
        return mean, np.sqrt(np.maximum(q / np.maximum(n, 1) - mean**2, 0))

    centre, scale = spread(n.sum(keepdims=True), s.sum(0), q.sum(0))
    scale = np.where(scale > 1e-12, scale, 1)
    rest, ones = n.sum() - n, p.sum() - p
    _, own = spread(rest[:, None], s.sum(0) - s, q.sum(0) - q)
    # Each fold's features are scaled by its own training side; that only changes what its penalty weighs.
    penalty = np.square(np.where(own > 1e-12, own, 1) / scale)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.stack([rest / (2 * (rest - ones)), rest / (2 * ones)], axis=1)
        share = np.where(rest > 0, ones / rest, np.nan)
    return Folds([r[record] for r in found], centre, scale, penalty, weights, share)


#: A block of training rows: the place of each row's record, its label, and its scaled features behind a constant, as bytes.
_BLOCK = "own binary, labels binary, points binary"


def _blocks(rows: DataFrame, folds: Folds, record: str, features: list[str], label: str) -> DataFrame:
    """The rows that train, an Arrow batch as one row, so that each round reads numbers and no rows."""
    place = {r: i for i, r in enumerate(folds.records)}
    shared = rows.sparkSession.sparkContext.broadcast((folds, place))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, where = shared.value
        for batch in batches:
            points, labels, own = _points(batch, known, where, len(features))
            use = np.isfinite(points).all(1) & np.isfinite(labels)
            if not use.any():
                continue
            block = own[use].astype(np.int64), labels[use].astype(np.float64), points[use].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], names=["own", "labels", "points"])

    return checkpoint(rows.select(record, label, *features).mapInArrow(run, _BLOCK))


def _newton_sums(blocks: DataFrame, folds: Folds, models: np.ndarray) -> DataFrame:
    """``fold, v0...``: gradient and upper half of the Hessian of every fold at its own model, of the rows that it trains on."""
    shared = blocks.sparkSession.sparkContext.broadcast((folds, models))
    d = models.shape[1]
    upper = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = shared.value
        total = np.zeros((len(at), d + len(upper[0])))
        for batch in batches:
            for own_, labels_, points_ in zip(*batch.columns, strict=True):
                own, labels = np.frombuffer(own_.as_buffer(), np.int64), np.frombuffer(labels_.as_buffer(), np.float64)
                points = np.frombuffer(points_.as_buffer(), np.float64).reshape(-1, d)
                outer = points[:, upper[0]] * points[:, upper[1]]
                for low in range(0, len(at), 256):  # folds by blocks, so that the batch times folds stays small
                    part = slice(low, low + 256)
                    chance = 1 / (1 + np.exp(-np.clip(points @ at[part].T, -500, 500)))
                    weight = np.where(labels[:, None] == 1, known.class_weights[part, 1], known.class_weights[part, 0])
                    weight[own[:, None] == np.arange(low, min(low + 256, len(at)))] = 0
                    weight = np.where(np.isfinite(weight), weight, 0)
                    total[part, :d] += (weight * (chance - labels[:, None])).T @ points
                    total[part, d:] += (weight * chance * (1 - chance)).T @ outer
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(list(total), pa.list_(pa.float64()))], names=["fold", "sums"])

    found = blocks.mapInArrow(run, "fold bigint, sums array<double>")
    parts = [F.sum(F.col("sums")[i]).alias(f"v{i}") for i in range(d + len(upper[0]))]
    return found.groupBy("fold").agg(*parts)


def _points(batch: pa.RecordBatch, folds: Folds, place: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled features behind a constant, labels (NaN where null), and the fold of each row's record."""
    numbers = [batch.column(2 + i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(d)]
    points = np.column_stack([np.ones(batch.num_rows), (np.column_stack(numbers) - folds.centre) / folds.scale])
    labels = batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
    each = batch.column(0).dictionary_encode("encode")  # each record of a batch is looked up once
    found = np.array([place[r] for r in each.dictionary.to_pylist()], np.int64)
    return points, labels, found[each.indices.to_numpy(zero_copy_only=False)]


def leave_one_out(rows: DataFrame, record: str, features: list[str], label: str, rounds: int = 50, within: float = 1e-10) -> DataFrame:
    """``rows`` with ``score``: each record's rows scored by a model of the other records.

    The models are logistic, with both classes weighted alike, features scaled by
    each training side, and half the squared length of the scaled weights as
    penalty.  All are fitted together: each round one aggregate gives every fold
    the gradient and Hessian of its own model over the rows that it trains on, and
    one Newton step is taken for each, until no step is larger than ``within``.
    The driver holds one row of numbers for each record.  Rows are packed into
    blocks of numbers once, and blocks meet the models of all records each round,
    as the folds are asked for.

    Rows without a label are scored and train nothing; rows with unknown features
    get no score.  A null record is a record of its own.  Where the other records
    have one class only, that class is the score, and null where they train nothing.
    """
    ship(rows.sparkSession)
    rows = checkpoint(rows)
    folds = _folds(rows, record, features, label)
    d, good = len(features) + 1, folds.trained
    upper = np.triu_indices(d)
    models = np.zeros((len(folds.records), d))
    penalty = np.column_stack([np.zeros(len(models)), folds.penalty])
    blocks = _blocks(rows, folds, record, features, label) if good.any() else None
    for _ in range(rounds if good.any() else 0):
        sums = np.zeros((len(models), d + len(upper[0])))
        for r in _newton_sums(blocks, folds, models).collect():
            sums[r[0]] = r[1:]
        hessian = np.zeros((len(models), d, d))
        hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = sums[:, d:]
        hessian[:, np.arange(d), np.arange(d)] += penalty
        step = np.zeros_like(models)
        step[good] = np.linalg.solve(hessian[good], (sums[:, :d] + penalty * models)[good][:, :, None])[:, :, 0]
        models = models - step
        if np.abs(step).max() <= within:
            break
    place = {r: i for i, r in enumerate(folds.records)}
    shared = rows.sparkSession.sparkContext.broadcast((folds, models, place))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, where = shared.value
        for batch in batches:
            points, _, own = _points(batch.select([record, label, *features]), known, where, len(features))
            score = 1 / (1 + np.exp(-np.clip((points * at[own]).sum(1), -500, 500)))
            score = np.where(known.trained[own] | ~np.isfinite(score), score, known.share[own])
            none = ~np.isfinite(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=none)], names=[*batch.schema.names, "score"])

    return map_arrow(rows, run, extended(rows.schema, score=T.DoubleType()))


def signal_band(lift: Column) -> Column:
    """What a lift over the base rate is worth."""
    return F.when(lift >= 5, "strong").when(lift >= 2, "useful").when(lift >= 1.2, "weak").otherwise("none")
