"""Embedding near-duplicates by product quantisation.

Vectors of one label are dealt to inverted lists by their nearest coarse
centroid; the residual is coded by the nearest codeword in each subspace.  A list
keeps each member's code and the code's error, made once when it is dealt.  A vector probes every list that can hold a
partner: with unit vectors a cosine of at least ``least`` is a distance of at
most ``sqrt(2 - 2 * least)``, and a list is left out only where the plane
between the two centroids is further away than that.  Within a list the
distances to the codes are summed from a query's lookup tables; a vector is
dropped only where that distance less the code's error is above the radius.  The
rest is decided by the exact cosine.  No link is lost: both bounds are proved.
Exact vectors stay beside the codes, in the width they came in: a vector's links
are counted, and in a dense group naming the pairs first would give their square.

The centroids and codewords are fitted on at most ``fit_rows`` vectors (those of
the smallest hash); every vector is indexed and probes.  Equal vectors of a
label are merged first.  A long list is cut into blocks, each of which is one
group of rows; links are handed on as counts and a spanning forest.

Rows: a null label, a null or empty vector, a zero one and one with null or
non-finite components link with nothing and keep themselves; vectors of
different lengths do not link; a null ``vec_id`` gets its row but names no
component; repeated rows count as other vectors; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, map_batches, read, record_batch
from .graph import connected_components
from .simhash import min_labels

#: Vectors that the index is fitted on, at most.
FIT_ROWS = 32_768
#: Vectors of a list, on average, that the number of lists aims at.
LIST_ROWS = 1024
#: Lists at most; there is no use in more than some for each eight vectors of the fit.
MAX_LISTS = FIT_ROWS // 8
#: Components of a subspace, and codewords of each.
SUBSPACE = 4
CODEWORDS = 256
#: Vectors of a block; a list's queries pass by it in a stream.
BLOCK_ROWS = 512
#: Numbers of the vectors of the pairs that are verified at once.
PAIR_NUMBERS = 1 << 21
#: Allowance for rounding in the bounds.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Coarse centroids (lists, d) and codewords (subspaces, codewords, SUBSPACE)."""

    centroids: np.ndarray
    codewords: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each point, and squared distances to all centroids."""
        far = _squares(points, self.centroids)
        return far.argmin(axis=1), far

    def encode(self, points: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they leave out."""
        rest = points - self.centroids[lists]
        codes = np.empty((len(points), len(self.codewords)), np.uint8)
        kept = np.empty_like(rest)
        for m, words in enumerate(self.codewords):
            part = slice(m * SUBSPACE, (m + 1) * SUBSPACE)
            codes[:, m] = _squares(rest[:, part], words).argmin(axis=1)
            kept[:, part] = words[codes[:, m]]
        return codes, np.linalg.norm(rest - kept, axis=1)

    def probes(self, points: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that may hold a vector within ``radius`` of each point."""
        own, far = self.nearest(points)
        apart = np.sqrt(_squares(self.centroids, self.centroids))
        gap = (far - far[np.arange(len(points)), own][:, None]) / np.maximum(2 * apart[own], 1e-12)
        return [np.flatnonzero(row <= radius + SLACK) for row in gap]

    def distances(self, queries: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to a list's codes, by lookup tables."""
        rest = queries - self.centroids[place]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, words in enumerate(self.codewords):
            table = _squares(rest[:, m * SUBSPACE : (m + 1) * SUBSPACE], words).astype(np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.square(a).sum(1)[:, None] - 2 * a @ b.T + np.square(b).sum(1), 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, by slices of bounded size."""
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([_squares(points[i : i + step], centres).argmin(axis=1) for i in range(0, len(points), step)])


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids from a fixed spread of starting points; an empty one keeps its place."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """An index fitted on unit vectors."""
    centroids = k_means(sample, lists)
    rest = sample - centroids[_nearest(sample, centroids)]
    parts = range(0, sample.shape[1], SUBSPACE)
    words = [k_means(rest[:, p : p + SUBSPACE], CODEWORDS) for p in parts]
    return Index(centroids, np.array(words))


def number_type(rows: DataFrame) -> type[np.floating]:
    """The type in which the table's vectors are kept without loss."""
    return np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def unit_rows(rows: DataFrame) -> DataFrame:
    """``vec_id, label, dim, cid, vec`` of the rows that can link.

    ``vec`` holds the vector's numbers as they came, floats or doubles; ``cid`` is
    a digest of the label and of the vector at unit length.
    """
    store = number_type(rows)
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    label_kind = rows.schema["label"].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, dims, cids, vecs = [], [], [], []
        for i, (label, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if label is None or not values or None in values:
                continue
            point = np.array(values, np.float64)
            most = np.abs(point).max()
            if not np.isfinite(most) or most == 0:
                continue
            point = point / most
            point = point / np.linalg.norm(point)
            keep.append(i)
            dims.append(len(values))
            cids.append(hashlib.md5(f"{label}|".encode() + (point + 0.0).tobytes()).hexdigest())
            vecs.append(np.array(values, store).tobytes())
        kept = pa.array(keep, pa.int32())
        made = record_batch(d=(dims, pa.int32()), c=(cids, pa.string()), v=(vecs, pa.binary()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(kept), batch.column(1).take(kept), *made.columns],
            names=["vec_id", "label", "dim", "cid", "vec"],
        )

    schema = f"vec_id {id_kind}, label {label_kind}, dim int, cid string, vec binary"
    return map_batches(rows.select("vec_id", "label", "embedding"), per_batch, schema)


def _padded(vecs: list[bytes], width: int, store: type[np.floating]) -> np.ndarray:
    """Stored vectors at unit length as rows, filled with zeros up to the index's width."""
    out = np.zeros((len(vecs), width))
    sizes = np.array([len(v) for v in vecs]) // np.dtype(store).itemsize
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[at, :n] = np.frombuffer(b"".join([vecs[i] for i in at]), store).reshape(len(at), n)
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), 1e-300)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]


def _linked(blocks: DataFrame, index, least: float, store: type[np.floating]) -> DataFrame:
    """Counts (``cid``, null, n) and forest links (``cid``, ``other``, 0) of every block.

    Rows of a block come together, its members before its queries.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * least))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        state: dict = {"key": None}

        def links(ids: list[str], times: np.ndarray, vecs: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
            """Links of queries with the block's members; ``inside``: the members themselves."""
            near = found.distances(vecs, state["list"], state["codes"]) <= radius + state["error"][None, :] + 1e-4
            if inside:
                near = np.triu(near | near.T, 1)
            i, j = np.nonzero(near)
            # Some pairs at a time, so that a dense block holds no copies of all its pairs' vectors.
            step = max(1, PAIR_NUMBERS // max(1, vecs.shape[1]))
            parts = [np.einsum("ij,ij->i", vecs[i[k : k + step]], state["vecs"][j[k : k + step]]) for k in range(0, len(i), step)]
            sure = np.concatenate([*parts, np.empty(0)]) >= least
            i, j = i[sure], j[sure]
            if not len(i):
                return
            n = len(ids)
            counts = np.bincount(i, state["times"][j], n).astype(np.int64)
            others = np.bincount(j, times[i], len(state["ids"])).astype(np.int64)
            names = np.array([*ids, *state["ids"]])
            labels = min_labels(len(names), i, j + n)
            if inside:  # the two halves name the same vectors
                labels = min_labels(n, i, j)
                child = np.flatnonzero(labels != np.arange(n))
            else:
                child = np.flatnonzero(labels != np.arange(len(names)))
            total = np.concatenate((counts, others))
            has = np.flatnonzero(total)
            yield record_batch(
                cid=([*names[has], *names[child]], pa.string()),
                other=([None] * len(has) + list(names[labels[child]]), pa.string()),
                n=([*total[has].tolist(), *[0] * len(child)], pa.int64()),
            )

        def start(key: tuple) -> None:
            state.clear()
            state.update(key=key, list=key[2], parts=[], ready=False)

        def close() -> Iterator[pa.RecordBatch]:
            if state["key"] is None or state["ready"]:
                return
            state["ids"] = [c for p in state["parts"] for c in p[0]]
            state["times"] = np.concatenate([p[1] for p in state["parts"]]) if state["parts"] else np.empty(0)
            state["vecs"] = np.concatenate([p[2] for p in state["parts"]]) if state["parts"] else np.empty((0, found.width))
            state["ready"] = True
            if state["ids"]:
                state["codes"] = np.frombuffer(b"".join(c for p in state["parts"] for c in p[3]), np.uint8).reshape(len(state["ids"]), -1)
                state["error"] = np.concatenate([p[4] for p in state["parts"]])
                if len(state["ids"]) > 1:
                    yield from links(state["ids"], state["times"], state["vecs"], True)

        for batch in batches:
            label, dim, place, block, query, cid = (batch.column(i).to_pylist() for i in range(6))
            times = batch.column(6).to_numpy(zero_copy_only=False).astype(np.float64)
            vecs = _padded(batch.column(7).to_pylist(), found.width, store)
            codes, error = batch.column(8).to_pylist(), batch.column(9).to_numpy(zero_copy_only=False)
            keys = list(zip(label, dim, place, block, query, strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at][:4] != state["key"]:
                    yield from close()
                    start(keys[at][:4])
                if not keys[at][4]:
                    state["parts"].append((cid[at:end], times[at:end], vecs[at:end], codes[at:end], error[at:end]))
                else:
                    yield from close()
                    if state["ids"]:
                        yield from links(cid[at:end], times[at:end], vecs[at:end], False)
                at = end
        yield from close()

    bound_batches(blocks.sparkSession)
    return blocks.mapInArrow(run, "cid string, other string, n bigint")


def link_classes(
    classes: DataFrame,
    least: float = 0.93,
    fit_rows: int = FIT_ROWS,
    block_rows: int = BLOCK_ROWS,
    list_rows: int = LIST_ROWS,
    store: type[np.floating] = np.float64,
) -> DataFrame:
    """Counts and forest links among distinct vectors ``label, dim, cid, vec, times``."""
    spark = classes.sparkSession
    shape = classes.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.approx_count_distinct("label").alias("labels")).first()
    if not shape.n:
        return spark.createDataFrame([], "cid string, other string, n bigint")
    width = -(-shape.dim // SUBSPACE) * SUBSPACE
    sample = [bytes(r.vec) for r in classes.select("vec").orderBy(F.xxhash64("cid"), "cid").limit(fit_rows).collect()]
    lists = min(MAX_LISTS, max(1, round(shape.n / max(1, shape.labels) / list_rows)))
    index = spark.sparkContext.broadcast(fit(_padded(sample, width, store), lists))
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    label_kind = classes.schema["label"].dataType.simpleString()

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = _padded(batch.column(3).to_pylist(), index.value.width, store)
        own, _ = index.value.nearest(points)
        codes, error = index.value.encode(points, own)
        # A pair of two lists meets in the one of the higher number.
        probed = [[int(x) for x in p if x > o] for p, o in zip(index.value.probes(points, radius), own, strict=True)]
        made = record_batch(
            list=(own, pa.int32()),
            probed=(probed, pa.list_(pa.int32())),
            codes=([c.tobytes() for c in codes], pa.binary()),
            error=(error.astype(np.float32), pa.float32()),
        )
        return pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *made.schema.names])

    dealt = cut(
        map_batches(
            classes.select("label", "dim", "cid", "vec", "times"),
            deal,
            f"label {label_kind}, dim int, cid string, vec binary, times bigint, list int, probed array<int>, "
            "codes binary, error float",
        )
    )
    sizes = dealt.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    at_home = dealt.join(sizes, ["label", "dim", "list"]).withColumn("own", own)
    # Within a list a block's rows query half of the other blocks, in a ring, so each pair of blocks meets once.
    steps = F.expr("filter(sequence(0, blocks div 2), s -> s = 0 OR 2 * s < blocks OR (2 * s = blocks AND own < s))")
    home = at_home.select(
        "label", "dim", "list", F.explode(steps).alias("step"), "own", "blocks", "cid", "times", "vec", "codes", "error"
    ).select(
        "label", "dim", "list", F.pmod(F.col("own") + F.col("step"), F.col("blocks")).alias("block"),
        (F.col("step") > 0).alias("query"), "cid", "times", "vec",
        F.when(F.col("step") == 0, F.col("codes")).alias("codes"), F.when(F.col("step") == 0, F.col("error")).alias("error"),
    )
    away = (
        dealt.select("label", "dim", F.explode("probed").alias("list"), "cid", "times", "vec")
        .join(sizes, ["label", "dim", "list"])
        .select(
            "label", "dim", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(True).alias("query"), "cid", "times", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("error"),
        )
    )
    keys = ["label", "dim", "list", "block"]
    rows = home.union(away).repartition(*keys).sortWithinPartitions(*keys, "query", "cid")
    return _linked(rows, index, least, store)


def near_duplicates(rows: DataFrame, least: float = 0.93, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows``."""
    valid = cut(unit_rows(rows))
    classes = cut(
        valid.groupBy("label", "dim", "cid").agg(F.count("*").alias("times"), F.min("vec_id").alias("least_id"), F.min("vec").alias("vec"))
    )
    found = cut(link_classes(classes, least, store=number_type(rows), **options))
    counts = found.where("other IS NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other IS NOT NULL").select("cid", "other"))
    rooted = classes.join(roots, classes.cid == roots.node, "left").select(
        "cid", "times", "least_id", F.coalesce("component", "cid").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = (
        rooted.join(named, "root")
        .join(counts, "cid", "left")
        .select("cid", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    )
    linking = valid.join(facts, "cid").select("vec_id", "n_links", "component_id")
    values = F.col("embedding")
    alone = F.col("label").isNull() | ~F.coalesce(
        (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0),
        F.lit(False),
    )
    rest = rows.where(alone).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the whole embeddings table."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
