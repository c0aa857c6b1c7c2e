"""Hard-negative mining by cover trees over norm-augmented candidates.

A candidate gets one more component that brings it to the largest norm ``M`` of
all, and a query a zero there.  Then the inner product of query ``q`` and
candidate ``c`` is ``(|q|^2 + M^2 - |q - c|^2) / 2``: the nearer, the larger.  A
node that covers its candidates within a radius around a centre thus bounds their
inner products from above and from below.

The tree's upper level is a farthest-first net of at most ``MAX_CELLS`` pivots; a
cell's candidates are dealt to blocks of bounded size, and each block is one cover
tree.  Below a node, centres are added until half its radius is covered or
``FANOUT`` of them are there, and every child keeps the radius that it covers.

A query asks for the best ``k`` rows whose score lies in a window.  It first asks
its own block, which gives a score that the k-th best reaches, and then every
block that may hold more.  In a block all queries descend together, best bounds
first; a node goes where its bounds lie outside the window or below the k-th
best, or where its only label is of no use.  Leaves are decided by exact integer
products.

Rows: null labels, null or empty vectors and null or non-finite components take
no part; a null ``vec_id`` is no anchor, and among ties it comes last; repeated
rows are rows of their own, anchors too; vectors of different widths are not
compared; scores beyond a long are the largest or smallest long; an anchor with
no positives, or a positive whose window is empty, gives no rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, map_batches, read, record_batch

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Pivots of the upper level, at most, and the bytes of the sample that they are chosen from.
MAX_CELLS = 1024
SAMPLE_BYTES = 8 << 20
#: Candidates of a block, at most, and bytes of their vectors.
BLOCK_ROWS = 4096
BLOCK_BYTES = 2 << 20
#: Candidates of a leaf; nodes below a node, at most.
LEAF_ROWS = 64
FANOUT = 32
#: Allowance for rounding, as a share of the squared lengths.
SLACK = 1e-6
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers kept as doubles, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    rows = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in exact[1]] for p in exact[0]]
    return np.array([[min(MOST, max(LEAST, x)) for x in row] for row in rows], np.int64)


def augmented(points: np.ndarray, norm: float) -> np.ndarray:
    """Points with one more component that brings each to the same length."""
    return np.hstack([points, np.sqrt(np.maximum(norm**2 - np.square(points).sum(1), 0))[:, None]])


def apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.linalg.norm(points - centre, axis=1)


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest inner product of each query with what each centre covers; centres are augmented."""
    squares = np.square(queries).sum(1)[:, None]
    far = np.sqrt(np.maximum(squares + norm**2 - 2 * queries @ centres[:, :-1].T, 0))
    slack = SLACK * (np.sqrt(squares) + norm) ** 2 + SLACK
    up = (squares + norm**2 - np.square(np.maximum(far - radius, 0))) / 2 + slack
    return up, (squares + norm**2 - np.square(far + radius)) / 2 - slack


@dataclass
class CoverTree:
    """Candidates in the order of the leaves, and nodes that each cover some of them.

    Node ``i`` covers candidates ``low[i]`` to ``high[i]`` within ``radius[i]`` of
    ``centres[i]``; its children are ``child[i]`` to ``last[i]``, none for a leaf.
    ``only[i]`` is the label that all it covers share, else -1.
    """

    norm: float
    points: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    labels: np.ndarray
    widths: np.ndarray
    label_names: dict[str, int]
    centres: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    last: np.ndarray
    only: np.ndarray


def build(points: np.ndarray, rows, ids, named, labels: list[str], widths, norm: float) -> CoverTree:
    """The cover tree of a block."""
    space = augmented(points, norm)
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    codes = np.array([names[x] for x in labels], np.int64)
    order = np.arange(len(points))
    root = int(apart(space, space.mean(0)).argmin())
    # (centre, radius, low, high, first child, last child + 1)
    nodes = [[root, float(apart(space, space[root]).max()), 0, len(points), 0, 0]]
    at = 0
    while at < len(nodes):
        centre, radius, low, high, *_ = nodes[at]
        if high - low > LEAF_ROWS and radius > 0:
            members = order[low:high]
            far, owner, centres = apart(space[members], space[centre]), np.zeros(high - low, np.int64), [centre]
            while len(centres) < min(FANOUT, -(-(high - low) // LEAF_ROWS)):
                next_one = int(far.argmax())
                if far[next_one] <= radius / 2:
                    break
                fresh = apart(space[members], space[members[next_one]])
                near = fresh < far
                owner[near], far[near] = len(centres), fresh[near]
                centres.append(int(members[next_one]))
            dealt = np.argsort(owner, kind="stable")
            order[low:high] = members[dealt]
            edges = low + np.searchsorted(owner[dealt], np.arange(len(centres) + 1))
            nodes[at][4:] = len(nodes), len(nodes) + len(centres)
            for k, c in enumerate(centres):
                nodes.append([c, float(far[owner == k].max()), int(edges[k]), int(edges[k + 1]), 0, 0])
        at += 1
    centre, radius, low, high, child, last = (np.array(x) for x in zip(*nodes, strict=True))
    codes = codes[order]
    only = np.array([codes[a] if (codes[a:b] == codes[a]).all() else -1 for a, b in zip(low, high, strict=True)])
    return CoverTree(
        norm, points[order], rows[order], ids[order], named[order], codes, widths[order], names, space[centre], radius, low, high, child, last, only
    )


@dataclass
class Asked:
    """Queries: their points, widths and own rows, the label that is asked for or shunned, windows and scores to reach."""

    points: np.ndarray
    widths: np.ndarray
    rows: np.ndarray
    labels: list[str]
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray


def search(tree: CoverTree, asked: Asked, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the best ``k`` candidates of each query in this tree."""
    label = np.array([tree.label_names.get(x, -2) for x in asked.labels], np.int64)
    floor = np.maximum(asked.floor, asked.low)

    def useful(q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        only = tree.only[nodes][None, :]
        return (only == -1) | (only == label[q][:, None]) if same else only != label[q][:, None]

    def opened(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down = bounds(asked.points[q], tree.centres[nodes], tree.radius[nodes], tree.norm)
        i, j = np.nonzero((up >= floor[q][:, None]) & (down <= asked.high[q][:, None]) & useful(q, nodes))
        return q[i], nodes[j], up[i, j]

    found = [np.empty(0, np.int64)] * 3
    query, node, up = opened(np.arange(len(label)), np.zeros(1, np.int64))
    step = 1
    while True:
        live = up >= floor[query]
        query, node, up = query[live], node[live], up[live]
        if not len(query):
            return tuple(found)
        order = np.lexsort((-up, query))
        query, node, up = query[order], node[order], up[order]
        now = np.arange(len(query)) - np.searchsorted(query, query) < step
        step *= 2
        later, fresh = [(query[~now], node[~now], up[~now])], [tuple(found)]
        q_now, n_now = query[now], node[now]
        by_node = np.argsort(n_now, kind="stable")
        for place in np.split(by_node, np.flatnonzero(np.diff(n_now[by_node])) + 1):
            q, at = q_now[place], int(n_now[place[0]])
            if tree.last[at]:
                later.append(opened(q, np.arange(tree.child[at], tree.last[at])))
                continue
            part = slice(tree.low[at], tree.high[at])
            score = products(asked.points[q], tree.points[part])
            alike = tree.labels[part][None, :] == label[q][:, None]
            good = (score >= floor[q][:, None]) & (score <= asked.high[q][:, None]) & (alike == same)
            good &= (tree.widths[part][None, :] == asked.widths[q][:, None]) & (tree.rows[part][None, :] != asked.rows[q][:, None])
            i, j = np.nonzero(good)
            fresh.append((q[i], j + tree.low[at], score[i, j]))
        query, node, up = (np.concatenate(x) for x in zip(*later, strict=True))
        q, c, s = (np.concatenate(x) for x in zip(*fresh, strict=True))
        order = np.lexsort((tree.ids[c], ~tree.named[c], -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found = [x[place < k] for x in (q, c, s)]
        full = place == k - 1
        floor[q[full]] = np.maximum(floor[q[full]], s[full])


def _points(vecs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, : len(v) // 8] = np.frombuffer(v)
    return out


def _whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, anchor, width, vec, norm`` of the rows that take part; ``vec`` holds whole numbers as doubles."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, widths, vecs, norms = [], [], [], []
        for i, (label, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if label is None or not values or None in values:
                continue
            point = np.array(values, np.float64)
            if not np.isfinite(point).all():
                continue
            point = np.floor(np.clip(point, -1e150, 1e150) * scale)
            keep.append(i)
            widths.append(len(point))
            vecs.append(point.tobytes())
            norms.append(float(np.sqrt(np.square(point).sum())))
        kept = pa.array(keep, pa.int32())
        made = record_batch(width=(widths, pa.int32()), vec=(vecs, pa.binary()), norm=(norms, pa.float64()))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(i).take(kept) for i in range(3)], *made.columns], names=["vec_id", "label", "anchor", *made.schema.names]
        )

    return map_batches(rows, per_batch, "vec_id bigint, label string, anchor boolean, width int, vec binary, norm double")


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first points, at most ``most``."""
    chosen, far = [0], apart(points, points[0])
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, apart(points, points[chosen[-1]]))
    return points[chosen]


def _trees(dealt: DataFrame, width: int, norm: float) -> DataFrame:
    """``block, tree`` of all candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            rows, ids, labels, widths, vecs = (list(x) for x in zip(*held, strict=True))
            named = np.array([x is not None for x in ids])
            numbers = np.array([x or 0 for x in ids], np.int64)
            tree = build(_points(vecs, width), np.array(rows, np.int64), numbers, named, labels, np.array(widths, np.int64), norm)
            return record_batch(block=([now], pa.int64()), tree=([pickle.dumps(tree, 5)], pa.binary()))

        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if held:
                        yield made()
                    now, held = block, []
                held.append(row)
        if held:
            yield made()

    rows = dealt.select("block", "row", "vec_id", "label", "width", "vec")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint, tree binary")


@dataclass
class Forest:
    """The trees and what is known of the cells above them."""

    trees: DataFrame
    blocks: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    norm: float
    width: int


def plant(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[Forest | None, DataFrame]:
    """The cover trees of all ``rows``, and the rows with their ``row`` number and ``block``."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    shape = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("width").alias("width")).first()
    if not shape.n:
        return None, rows.withColumn("block", F.lit(0).cast("bigint"))
    norm, width = shape.norm, shape.width
    block_rows = max(LEAF_ROWS, min(block_rows, BLOCK_BYTES // (8 * width)))
    some = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(max(1, SAMPLE_BYTES // (8 * width))).collect()
    cells = min(MAX_CELLS, -(-shape.n // block_rows))
    pivots = net(augmented(_points([bytes(r.vec) for r in some], width), norm), cells)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = augmented(_points(batch.column(0).to_pylist(), width), norm)
        far = np.stack([apart(points, p) for p in pivots], axis=1)
        own = far.argmin(axis=1)
        made = record_batch(cell=(own, pa.int32()), far=(far[np.arange(len(own)), own], pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *made.schema.names])

    kinds = "vec binary, row bigint, vec_id bigint, label string, anchor boolean, width int, cell int, far double"
    dealt = cut(map_batches(rows.select("vec", "row", "vec_id", "label", "anchor", "width"), deal, kinds))
    stats = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).collect()
    radius = np.full(len(pivots), -np.inf)
    for s in stats:
        radius[s.cell] = s.radius
    blocks = rows.sparkSession.createDataFrame([(s.cell, s.blocks) for s in stats], "cell int, blocks int")
    place = F.pmod(F.xxhash64("row"), F.col("blocks"))
    dealt = dealt.join(F.broadcast(blocks), "cell").withColumn("block", F.shiftleft(F.col("cell").cast("bigint"), 32) + place)
    trees = cut(_trees(dealt, width, norm))
    return Forest(trees, blocks, pivots, radius, norm, width), dealt


def _ask(forest: Forest, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """``row, window, vec_id, score`` that each query finds in the block it names.

    ``queries`` has ``block, row, label, width, vec`` and arrays ``low, high, floor`` by window.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            blocks = batch.column(0).to_pylist()
            at = 0
            while at < len(blocks):
                end = at + 1
                while end < len(blocks) and blocks[end] == blocks[at]:
                    end += 1
                part = [c.slice(at, end - at).to_pylist() for c in batch.columns]
                if part[1][0] is not None:
                    now, tree = blocks[at], pickle.loads(part[1][0])
                    part = [x[1:] for x in part]
                elif now != blocks[at]:
                    raise RuntimeError("a block has queries and no tree")
                at = end
                if not part[0]:
                    continue
                _, _, rows, labels, widths, vecs, low, high, floor = part
                windows = np.array([len(x) for x in low])
                of = np.repeat(np.arange(len(rows)), windows)
                number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                flat = [np.array([y for x in v for y in x], np.int64) for v in (low, high, floor)]
                row, names = np.array(rows, np.int64)[of], [labels[i] for i in of]
                asked = Asked(_points(vecs, forest_width)[of], np.array(widths, np.int64)[of], row, names, *flat)
                q, c, s = search(tree, asked, same, k)
                ids = pa.array(tree.ids[c], pa.int64(), mask=~tree.named[c])
                columns = [pa.array(row[q]), pa.array(number[q].astype(np.int32)), ids, pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "window", "vec_id", "score"])

    forest_width = forest.width
    names = ["row", "label", "width", "vec", "low", "high", "floor"]
    asked = queries.select("block", F.lit(None).cast("binary").alias("tree"), *names)
    kinds = {f.name: f.dataType for f in asked.schema}
    trees = forest.trees.select("block", "tree", *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    rows = trees.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("tree").isNull())
    return rows.mapInArrow(run, "row bigint, window int, vec_id bigint, score bigint")


def _cells_to_ask(forest: Forest, queries: DataFrame) -> DataFrame:
    """The queries with each block but their own that may hold an answer."""
    pivots, radius, norm, width = forest.pivots, forest.radius, forest.norm, forest.width
    names = ["block", "row", "label", "width", "vec", "low", "high", "floor"]

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = _points(batch.column(4).to_pylist(), width)
        up, down = bounds(points, pivots, np.maximum(radius, 0), norm)
        cells = []
        for i, windows in enumerate(zip(*(batch.column(j).to_pylist() for j in (5, 6, 7)), strict=True)):
            open_ = np.zeros(len(pivots), bool)
            for low, high, floor in zip(*windows, strict=True):
                open_ |= (up[i] >= max(low, floor)) & (down[i] <= high)
            cells.append(np.flatnonzero(open_ & (radius >= 0)).tolist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*names, "cells"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*names).schema)
    routed = map_batches(queries.select(*names), per_batch, f"{kinds}, cells array<int>")
    # One row for each of at most MAX_CELLS cells.
    each = routed.withColumn("cell", F.explode("cells")).join(F.broadcast(forest.blocks), "cell")
    each = each.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("place")
    return each.where(other != F.col("block")).withColumn("block", other).select(*names)


def best(forest: Forest, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """``row, window, rank, vec_id, score``: the best ``k`` of each query's windows; ``queries`` names each one's own block."""
    ranks = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    queries = queries.withColumn("floor", F.transform("low", lambda _: F.lit(LEAST).cast("bigint")))
    near = cut(_ask(forest, queries, same, k))
    reached = near.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") == k)
    floors = reached.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    places = F.sequence(F.lit(0), F.size("low") - 1)
    known = F.transform(places, lambda i: F.coalesce(F.element_at("reached", i), F.lit(LEAST).cast("bigint")))
    told = queries.drop("floor").join(floors, "row", "left").withColumn("floor", known)
    found = near.unionByName(_ask(forest, _cells_to_ask(forest, told), same, k))
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, embedding``; ``anchor`` tells which of them are
    anchors.  Components count as ``floor(scale * x)``.  A positive is one of the
    best ``positives`` other rows of the anchor's label, a negative one of the best
    ``negatives`` rows of other labels whose score is between ``low`` and ``high``
    hundredths of the positive's.
    """
    inputs = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
    forest, dealt = plant(_whole_numbers(inputs, scale), block_rows)
    names = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if forest is None:
        return rows.sparkSession.createDataFrame([], names)
    anchors = cut(dealt.where("anchor").select("block", "row", "vec_id", "label", "width", "vec"))

    def one(value: int) -> Column:
        return F.array(F.lit(value).cast("bigint"))

    near = cut(best(forest, anchors.withColumns({"low": one(LEAST), "high": one(MOST)}), True, positives))
    own = near.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Positives of one score share a window.
    windows = own.groupBy("row").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))

    def share(hundredths: int, rounded: str) -> Column:
        return F.expr(f"transform(scores, s -> cast({rounded}(cast(s as decimal(20,0)) * {hundredths} / 100) as bigint))")

    # A negative positive score leaves nothing between its bounds.
    windows = windows.withColumn("scores", F.expr("filter(scores, s -> s >= 0)")).where(F.size("scores") > 0)
    asked = anchors.join(windows.withColumns({"low": share(low, "ceil"), "high": share(high, "floor")}), "row")
    asked = cut(asked)
    found = best(forest, asked.drop("scores"), False, negatives).join(asked.select("row", "scores"), "row")
    found = found.select("row", F.element_at("scores", F.col("window") + 1).alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = own.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return found.join(named, ["row", "positive_score"]).select(*[n.split()[0] for n in names.split(", ")])


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of the whole embeddings table; every seventh row has another label."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: The same in SQL: every anchor's products with all rows.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS alike,
    CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON len(a.e) = len(v.e) AND a.r <> v.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives AS p JOIN scored AS n ON n.anchor = p.anchor AND NOT n.alike
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
