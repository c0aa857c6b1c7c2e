"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit
segments.  The Manhattan distance of two embeddings is never above the Hamming
distance of the fingerprints, so every pair within ``max_distance`` bits is also
within that Manhattan distance.  The segments are dealt to a few parts such that
in one part at least the pair is within Manhattan distance two; there both
points reach a common grid cell by one step each.  Joining on the cell therefore
finds every pair, and the exact bit difference decides.

Equal fingerprints are merged first, each cell hands on a spanning forest of its
links and not the links themselves, and crowded cells are split into pairs of
blocks, so no task holds an unbounded group.

``near_duplicates`` takes one word of 64 bits from word shingles.  ``keep_one``,
for dropping copies, takes two words of 64 bits from a text's different words:
documents of five-word similarity 0.8 differ in a tenth of a shingle
fingerprint's bits and more, but in few of these.  There the bits only find
candidates; the exact Jaccard similarity of the five-word shingles decides.  What
is still unlinked then is looked for by shared shingles, the rare ones first, so
that no similar pair depends on its bits.  An odd sketch, the parities of the shingles' hashes by place, goes before it: two
sketches never differ in more places than the shingle sets differ in members, so
no pair that is similar enough is lost to it.

Rows: a null or wordless text has fingerprint zero; a null ``doc_id`` gets its
row but never names a component; repeated rows each get theirs; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.columns import column, extended

from .common import ASCII_LOWER, cut, map_batches, read, record_batch, row_hash, text_or_empty
from .graph import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
SEGMENTS = 32
#: Cells of more rows than this are compared block by block.
BLOCK_ROWS = 4096
#: A home cell below this is never the cause of a crowded cell: at most 33 home
#: cells reach one cell, which makes about BLOCK_ROWS rows.
WARM_ROWS = BLOCK_ROWS // 33
#: Crowded cells are broadcast up to this many (12 bytes each), else joined.
BROADCAST_CELLS = 50_000
#: Differing bits of 128 up to which fingerprints link documents that are then verified: what six parts find.
COPY_BITS = 17
#: Shingles that make up this share of all are looked at last.
COMMON_SHARE = 5e-6
#: Jaccard similarity of word shingles from which documents count as copies.
COPY_JACCARD = 0.8
#: Words of these shingles.
SHINGLE_WORDS = 5
#: Words of 64 bits of the odd sketch of a text's shingles.
SKETCH_WORDS = 8
#: Unlinked partners of a row that share a shingle with it, the most alike first, that are verified by the end of the first round; eight
#: times as many by the end of each next, until there are no more.
FIRST_PARTNERS = 32
#: Pairs that a task holds before it reduces them to a spanning forest.
HELD_PAIRS = 1 << 19
#: Rows to drop are broadcast up to this many (17 bytes each), else joined by shuffles.
BROADCAST_ROWS = 1_000_000
#: Groups up to this size are compared by shifting the whole batch.
SHIFT_ROWS = 48


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of a UTF-8 text: majority bits over all its word shingles."""
    words = WORD.findall(text.translate(ASCII_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(starts), step):
        spans = zip(starts[at : at + step].tolist(), ends[at : at + step].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """Sixteen bytes of hash of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint8).reshape(-1, 16)


def word_fingerprint(text: bytes) -> tuple[int, int]:
    """Two words of majority bits over a text's different words."""
    return _majority(_word_hashes(set(WORD.findall(text.translate(ASCII_LOWER)))))


def _majority(hashes: np.ndarray) -> tuple[int, int]:
    if not len(hashes):
        return 0, 0
    counts, step = np.zeros(128, np.int64), 1 << 15
    for at in range(0, len(hashes), step):
        counts += np.unpackbits(hashes[at : at + step], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    low, high = np.packbits(bits, bitorder="little").view("<u8")
    return int(low), int(high)


def fingerprints(docs: DataFrame, key: list[str], of: Callable[[bytes], tuple[int, ...]], words: int = 1) -> DataFrame:
    """``key`` columns of every document and its fingerprint's ``words`` (signed longs ``fp0``, ...)."""
    names = [f"fp{i}" for i in range(words)]
    schema = extended([docs.schema[k] for k in key], **dict.fromkeys(names, T.LongType()))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("_text").to_pylist()
        found = np.array([of((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
        columns = [batch.column(f"_k{i}") for i in range(len(key))] + [pa.array(found[:, i]) for i in range(words)]
        return pa.RecordBatch.from_arrays(columns, names=[*key, *names])

    inputs = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("text").alias("_text"))
    return map_batches(inputs, per_batch, schema)


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in two bits of the result."""
    fps = fps.view(np.uint64)
    return fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))


def parts(max_distance: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, first segment, last + 1) such that a pair is within distance 2 in one of them."""
    n = max(2, -(-(max_distance // 3 + 1) // words))
    edges = [round(i * SEGMENTS / n) for i in range(n + 1)]
    return [(word, a, b) for word in range(words) for a, b in zip(edges, edges[1:], strict=False)]


def cells_of(fps: list[np.ndarray], max_distance: int, reach: bool) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index) pairs: home cells and, with ``reach``, those one step away."""
    grid, index = [], []
    everyone = np.arange(len(fps[0]))
    for part, (word, low, high) in enumerate(parts(max_distance, len(fps))):
        width = np.uint64(2 * (high - low))
        points = (embed(fps[word]) >> np.uint64(2 * low)) & ((np.uint64(1) << width) - np.uint64(1))
        tag = np.uint64(part << 33)
        grid.append(points | tag)
        index.append(everyone)
        for i in range(high - low) if reach else ():
            count, one = (points >> np.uint64(2 * i)) & np.uint64(3), np.uint64(1 << (2 * i))
            up, down = count < 2, count > 0
            grid += [points[up] + one | tag, points[down] - one | tag]
            index += [everyone[up], everyone[down]]
    return np.concatenate(grid).view(np.int64), np.concatenate(index)


def first_met(cell: np.ndarray, fps: list[np.ndarray], a: np.ndarray, b: np.ndarray, max_distance: int) -> np.ndarray:
    """Whether the rows ``a`` and ``b`` of a cell meet there first: each pair is due in one of its cells.

    That is in the first part where they are within distance two, and there in the
    smallest cell that both reach.  Only the low bits of a cell name a place.
    """
    spans, one = parts(max_distance, len(fps)), np.uint64(1)
    points = [embed(w) for w in fps]
    unary = [p | ((p >> one) & np.uint64(0x5555555555555555)) for p in points]
    due = np.full(len(a), -1, np.int64)
    for part in range(len(spans) - 1, -1, -1):
        word, low, high = spans[part]
        shift, mask = np.uint64(2 * low), (one << np.uint64(2 * (high - low))) - one
        apart = np.bitwise_count(((unary[word][a] ^ unary[word][b]) >> shift) & mask)
        x, y = (points[word][a] >> shift) & mask, (points[word][b] >> shift) & mask
        differ = x ^ y
        # The lowest differing segment of two; taken from either side it gives the two cells between.
        bit = differ & (~differ + one)
        segment = np.where(bit & np.uint64(0x5555555555555555), bit | (bit << one), bit | (bit >> one))
        between = np.minimum((x & ~segment) | (y & segment), (y & ~segment) | (x & segment))
        middle = np.where(differ == segment & np.uint64(0xAAAAAAAAAAAAAAAA), (x + y) >> one, between)
        place = np.where(apart == 2, middle, np.minimum(x, y)) | np.uint64(part << 33)
        due = np.where(apart <= 2, place.view(np.int64), due)
    return (cell[a] & ((1 << 38) - 1)) == due


def _to_cells(fps: DataFrame, max_distance: int, reach: bool) -> DataFrame:
    names = [c for c in fps.columns if re.fullmatch(r"fp\d", c)]

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        grid, index = cells_of(values, max_distance, reach)
        return pa.RecordBatch.from_arrays([pa.array(grid), *[pa.array(v[index]) for v in values]], names=["cell", *names])

    return map_batches(fps.select(*names), per_batch, ", ".join(f"{n} bigint" for n in ["cell", *names]))


def _reached(cells: DataFrame, max_distance: int, words: int) -> DataFrame:
    """Cells within one step of the given ones, each with the rows it may get."""
    spans = parts(max_distance, words)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, rows = [], []
        for cell, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, low, high = spans[cell >> 33]
            near = [cell]
            for i in range(high - low):
                count = (cell >> (2 * i)) & 3
                near += [cell + (1 << (2 * i))] * (count < 2) + [cell - (1 << (2 * i))] * (count > 0)
            out += near
            rows += [n] * len(near)
        return record_batch(cell=(out, pa.int64()), n=(rows, pa.int64()))

    return map_batches(cells, per_batch, "cell bigint, n bigint")


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over links ``a[i]-b[i]``."""
    labels = np.arange(n)
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        if np.array_equal(new, labels):
            break
        labels = new
    return labels


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the links of the smallest ranks that connect what all links connect (Boruvka)."""
    component, chosen, none = np.arange(n), np.empty(0, np.int64), len(a)
    by_rank = np.argsort(rank)
    while True:
        from_a, from_b = component[a], component[b]
        live = from_a != from_b
        if not live.any():
            return chosen
        best = np.full(n, none)
        np.minimum.at(best, from_a[live], rank[live])
        np.minimum.at(best, from_b[live], rank[live])
        chosen = np.union1d(chosen, by_rank[np.unique(best[best < none])])
        component = min_labels(n, a[chosen], b[chosen])


def _bits_apart(words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words)


def near_pairs(cell: np.ndarray, words: list[np.ndarray], max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``a < b`` of a cell within the distance, all of one ``a`` together; without ``words`` all of them. Rows are sorted by cell."""
    bounds = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    left, right = [bounds[:0]], [bounds[:0]]
    rows = np.flatnonzero((size > 1) & (size <= SHIFT_ROWS))
    for shift in range(1, SHIFT_ROWS):
        rows = rows[rows + shift < len(cell)]
        rows = rows[cell[rows] == cell[rows + shift]]
        if not len(rows):
            break
        near = rows[_bits_apart(words, rows, rows + shift) <= max_distance] if words else rows
        left.append(near)
        right.append(near + shift)
    yield np.concatenate(left), np.concatenate(right)
    for start, end in zip(bounds, bounds[1:], strict=False):
        if end - start > SHIFT_ROWS:
            for at in range(start, end, 128):
                mine = np.arange(at, min(at + 128, end))
                near = _bits_apart(words, mine[:, None], np.arange(at, end)[None, :]) <= max_distance if words else np.ones((len(mine), end - at), bool)
                i, j = np.nonzero(near)
                yield at + i[i < j], at + j[i < j]


def forest(
    cell: np.ndarray, words: list[np.ndarray], max_distance: int, unlike: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within the cells, as pairs of rows; rows are sorted by cell.

    Links are pairs for which ``unlike`` is not below 0; those it is least for
    come first.  A forest of a part of the links and the rest of them have the
    same forest as all of them, so few are held at a time.
    """
    words = [w.view(np.uint64) for w in words]
    held, n = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))], 0

    def reduce() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, far = (np.concatenate(x) for x in zip(*held, strict=True))
        used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        # The most alike pairs first, in an order that all cells share: then they name mostly the same links.
        low = [np.minimum(w[a], w[b]) for w in words]
        rank = np.empty(len(a), np.int64)
        rank[np.lexsort([*[w[a] ^ w[b] for w in words], *low, _bits_apart(words, a, b), far])] = np.arange(len(a))
        tree = spanning_forest(len(used), place[: len(a)], place[len(a) :], rank)
        return a[tree], b[tree], far[tree]

    for a, b in near_pairs(cell, words, max_distance):
        far = unlike(a, b)
        good = far >= 0
        held.append((a[good], b[good], far[good].astype(np.int32)))
        n += len(held[-1][0])
        if n > HELD_PAIRS:
            held = [reduce()]
            n = len(held[0][0])
    a, b, _ = reduce()
    swap = words[0][a] > words[0][b]
    return np.where(swap, b, a), np.where(swap, a, b)


Emit = Callable[..., Iterator[pa.RecordBatch]]


def by_cell(emit: Emit) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that hands whole cells, some at a time, to ``emit`` as arrays.

    The first column is the cell, by which the rows are dealt and sorted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            if len(held[0]) < 1 << 16:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from emit(*[x[:last] for x in held])
            held = [x[last:] for x in held]
        if held is not None:
            yield from emit(*held)

    return run


def _node(words: int) -> Column:
    """The fingerprint as one orderable value: the number itself, or hex digits of several."""
    if words == 1:
        return F.col("fp0")
    return F.concat(*[F.lpad(F.hex(f"fp{i}"), 16, "0") for i in range(words)])


def _forests(cells: DataFrame, max_distance: int) -> DataFrame:
    """Spanning links ``a, b`` of every cell, by ``fp0``; ``cells`` is dealt and sorted by cell."""

    n = len(cells.columns) - 1
    kind = pa.int64() if n == 1 else pa.string()

    def names(words: list[np.ndarray], rows: np.ndarray) -> pa.Array:
        if n == 1:
            return pa.array(words[0][rows], kind)
        both = zip(*[w.view(np.uint64)[rows].tolist() for w in words], strict=True)
        return pa.array(["".join(f"{x:016X}" for x in item) for item in both], kind)

    def emit(cell: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = [w.view(np.uint64) for w in words]
        a, b = forest(cell, list(words), max_distance, lambda a, b: np.where(first_met(cell, fps, a, b, max_distance), 0, -1))
        if len(a):
            yield pa.RecordBatch.from_arrays([names(words, a), names(words, b)], names=["a", "b"])

    spark_kind = "bigint" if n == 1 else "string"
    return cells.mapInArrow(by_cell(emit), f"a {spark_kind}, b {spark_kind}")


def _split_crowded(cells: DataFrame, fps: DataFrame, max_distance: int, block_rows: int) -> DataFrame:
    """Deal the rows of crowded cells to pairs of blocks; others stay as they are."""
    warm = (
        _to_cells(fps, max_distance, reach=False)
        .groupBy("cell")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > max(1, block_rows // 33))
    )
    crowded = cut(
        _reached(warm, max_distance, len(cells.columns) - 1)
        .groupBy("cell")
        .agg(F.ceil((F.sum("n") + block_rows) / block_rows).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    if (n := crowded.count()) == 0:
        return cells
    block = F.pmod(F.xxhash64(*cells.columns[1:]), F.col("blocks")).cast("int")
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        cells.join(F.broadcast(crowded) if n <= BROADCAST_CELLS else crowded, "cell", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", block)
        .withColumn("other", pair)
    )
    low, high = F.least("own", "other").cast("bigint"), F.greatest("own", "other").cast("bigint")
    return dealt.select((F.col("cell") + F.shiftleft(low * F.col("blocks") + high, 38)).alias("cell"), *cells.columns[1:])


def link_fingerprints(fps: DataFrame, max_distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``node, root`` for every fingerprint linked, over links, to a different one.

    ``fps`` holds distinct fingerprints, in columns ``fp0`` and on.  ``root`` is
    the smallest linked one.
    """
    cells = _split_crowded(_to_cells(fps, max_distance, reach=True), fps, max_distance, block_rows)
    links = _forests(cells.repartition("cell").sortWithinPartitions("cell"), max_distance)
    return connected_components(links).withColumnRenamed("component", "root")


def _rooted(marked: DataFrame, first: Column, max_distance: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The distinct fingerprints with their ``root`` and ``best``, the first of the rows under that root."""
    words = [c for c in marked.columns if re.fullmatch(r"fp\d", c)]
    classes = cut(marked.groupBy(*words).agg(F.min(first).alias("first")).withColumn("node", _node(len(words))))
    rooted = classes.join(link_fingerprints(classes.select(*words), max_distance, block_rows), "node", "left").select(
        *words, "first", F.coalesce("root", "node").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.select(*words, "root").join(named, "root").select(*words, "best")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_distance: int = 4, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    ``max_distance`` differing bits.
    """
    marked = cut(fingerprints(docs, ["doc_id"], lambda text: (fingerprint(text, shingle),)))
    named = _rooted(marked, F.col("doc_id"), max_distance, block_rows)
    return marked.join(named, "fp0").select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id")
    )


def _shingles(words: list[bytes], names: dict[bytes, int], hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The different hashes of word shingles, sorted; fewer words are one shingle, and none are none."""
    width = min(width, len(words))
    if not width:
        return np.empty(0, np.int64)
    number = np.ascontiguousarray(hashes[:, :8]).view("<u8")[:, 0][np.fromiter(map(names.__getitem__, words), np.int64, len(words))]
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total += number[i : i + len(total)] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64))
    return np.unique(total.view(np.int64))


def shingle_hashes(text: bytes) -> np.ndarray:
    """The different hashes of a text's five-word shingles, sorted."""
    words = WORD.findall(text.translate(ASCII_LOWER))
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return _shingles(words, names, _word_hashes(names))


def copy_marks(text: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """What copies are found by: the word fingerprint, two words of digest that name the
    sequence of words, the number of its different shingles, and their odd sketch; then the shingles."""
    words = WORD.findall(text.translate(ASCII_LOWER))
    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    hashes = _word_hashes(names)
    shingles = _shingles(words, names, hashes)
    places = (shingles.view(np.uint64) >> np.uint64(7)) % np.uint64(64 * SKETCH_WORDS)
    odd = (np.bincount(places.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    sketch = np.packbits(odd, bitorder="little").view("<u8").tolist()
    return (*_majority(hashes), digest >> 64, digest & ((1 << 64) - 1), len(shingles), *sketch), shingles


#: Columns of a text's marks: fingerprint, digest, shingles, sketch.
MARKS = [f"fp{i}" for i in range(5 + SKETCH_WORDS)]


def most_different(sizes: np.ndarray, least: float) -> np.ndarray:
    """Members by which two sets of these sizes together may differ at that Jaccard similarity."""
    return sizes * ((1 - least) / (1 + least)) + 1e-6


def _unlike(marks: list[np.ndarray], least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """How far pairs of rows differ by size and sketch, in 10,000ths of what two sets may differ at most, or -1 beyond it.

    ``marks`` are the columns from the number of shingles on.
    """
    size, sketch = marks[0], [m.view(np.uint64) for m in marks[1:]]

    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int32)
        for at in range(0, len(a), 1 << 17):
            i, j = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            share = np.maximum(_bits_apart(sketch, i, j), np.abs(size[i] - size[j])) / most_different(size[i] + size[j], least)
            out[at : at + (1 << 17)] = np.where(share <= 1, share * 10_000, -1)
        return out

    return far


def _hex_names(high: np.ndarray, low: np.ndarray) -> pa.Array:
    both = zip(high.view(np.uint64).tolist(), low.view(np.uint64).tolist(), strict=True)
    return pa.array([f"{x:016X}{y:016X}" for x, y in both], pa.string())


#: Columns of a row in a shingle's cell: digest, shingles, sketch, place of the shingle among the row's, label, shingle.
CELL = [*MARKS[2:], "at", "label", "shingle"]


def _unlinked(rows: DataFrame, least: float, most: int) -> DataFrame:
    """Pairs ``a, b`` of different labels in a shingle's cell that may be similar enough, of each row the ``most`` most alike.

    A pair is due at the first shingle that both have: then they share nothing
    before it, and no more from there on than what is left of either.  A row of
    nulls names a ``shingle`` of which there are more.  ``rows`` has ``cell`` and ``CELL``.
    """

    def emit(cell: np.ndarray, *marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        high, low, size, *sketch = marks[: 3 + SKETCH_WORDS]
        at, label, shingle = marks[3 + SKETCH_WORDS :]
        far, more = _unlike([size, *sketch], least), []
        for a, b in near_pairs(cell, [], 0):
            left = np.minimum(size[a] - at[a], size[b] - at[b])
            due = (label[a] != label[b]) & (left >= (size[a] + size[b]) * (least / (1 + least)) - 1e-6)
            a, b = a[due], b[due]
            share = far(a, b)
            a, b, share = a[share >= 0], b[share >= 0], share[share >= 0]
            order = np.lexsort((b, share, a))
            a, b = a[order], b[order]
            now = np.arange(len(a)) - np.searchsorted(a, a) < most
            more.append(np.unique(shingle[a[~now]]))
            if now.any():
                names = [_hex_names(high[x], low[x]) for x in (a[now], b[now])]
                yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(names[0]), pa.int64())], names=["a", "b", "shingle"])
        unfinished = np.unique(np.concatenate(more)) if more else np.empty(0, np.int64)
        if len(unfinished):
            none = pa.nulls(len(unfinished), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(unfinished)], names=["a", "b", "shingle"])

    return rows.mapInArrow(by_cell(emit), "a string, b string, shingle bigint")


def _blocked(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of cells, those of crowded cells dealt to pairs of blocks."""
    crowded = cut(rows.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1"))
    if n := crowded.count():
        dealt = (
            rows.join(F.broadcast(crowded) if n <= BROADCAST_CELLS else crowded, "cell", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("fp2", "fp3"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        )
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        rows = dealt.withColumn("cell", F.when(F.col("blocks") > 1, pair).otherwise(F.col("cell"))).select(*rows.columns)
    return rows


def wide_sketch(shingles: np.ndarray) -> bytes:
    """The parities of a set's hashes in as many places as it has members, rounded up to a power of two."""
    places = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles.view(np.uint64) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_apart(a: bytes, b: bytes) -> int:
    """Places in which two sets' sketches differ: never more than the sets' members.  A wider sketch is folded."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of rows of ``node, _text``."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_batches(texts.select("node", "_text"), per_batch, "node string, shingles array<bigint>")


def _sifted(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs of nodes that their sets' sizes and wide sketches let pass, so that few whole sets travel."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        near = [sketches_apart(x, y) <= most_different(n + m, least) for n, m, x, y in zip(*columns, strict=True)]
        return batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    side = lambda c, n, x: classes.select(F.col("node").alias(c), F.col(MARKS[4]).alias(n), F.col("wide").alias(x))
    met = pairs.join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a").where("n > 0 AND m > 0")
    sized = F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9
    return map_batches(met.where(sized).select("a", "b", "n", "m", "x", "y"), per_batch, "a string, b string")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose shingle sets have at least that Jaccard similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    rated = pairs.join(y, "b").join(x, "a").select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s"))
    return rated.where(F.col("c") >= least * (F.col("s") - F.col("c")) - 1e-9).where("s > 0").select("a", "b")


def common_shingles(texts: DataFrame, share: float = COMMON_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that make up at least ``share`` of all, sorted, and how often they were seen.

    A unit names those that come twice in it and make up half of that share there.
    They only tell which shingles to look at last: at most ``1 / share`` of them.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= max(2, n.sum() * share / 2)
        return record_batch(shingle=([*found[often].tolist(), None], pa.int64()), n=([*n[often].tolist(), int(n.sum())], pa.int64()))

    sums = cut(map_batches(texts, per_batch, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")))
    total = sums.where("shingle IS NULL").first()
    rows = sums.where("shingle IS NOT NULL").where(F.col("n") >= share * total.n).collect() if total else []
    found = np.array(sorted((r.shingle, r.n) for r in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def rare_first(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles in an order of all shingles, common ones last: two sets that are similar enough share one of them."""
    keys, counts = common
    seen = np.zeros(len(shingles), np.int64)
    if len(keys):
        place = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        seen = np.where(keys[place] == shingles, counts[place], 0)
    need = len(shingles) - int(np.ceil(len(shingles) * least - 1e-9)) + 1
    return shingles[np.lexsort((shingles, seen))[:need]]


def _marked(hashed: DataFrame, least: float) -> DataFrame:
    """``doc_id, _row``, the marks of every row's text, its wide sketch, and the shingles that a copy of it must share one of."""
    common = hashed.sparkSession.sparkContext.broadcast(common_shingles(hashed.select(text_or_empty().alias("_text"))))
    keys = ["doc_id", "_row"]

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, wide, first = [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            own, shingles = copy_marks(text)
            marks.append(own)
            wide.append(wide_sketch(shingles))
            first.append(rare_first(shingles, common.value, least) if len(shingles) else shingles)
        found = np.array(marks, np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), *[pa.array(found[:, i]) for i in range(len(MARKS))], pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *MARKS, "wide", "first_shingles"])

    own = dict.fromkeys(MARKS, T.LongType()) | {"wide": T.BinaryType(), "first_shingles": T.ArrayType(T.LongType())}
    schema = extended([hashed.schema[k] for k in keys], **own)
    return map_batches(hashed.select(*keys, text_or_empty().alias("_text")), per_batch, schema)


def _pairs_of(links: DataFrame) -> DataFrame:
    """Links as pairs ``a < b``, each once."""
    a, b = links.columns
    return links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _copies(classes: DataFrame, hashed: DataFrame, max_distance: int, least: float) -> DataFrame:
    """``node, component`` of the classes of equal texts that have a copy of at least that similarity.

    Cells give a spanning forest of the near fingerprints, whose texts are verified
    first; that links most copies.  What fingerprints cannot reach is found by the
    shingles themselves: two sets that are similar enough share one of each set's
    first shingles, so only where such a shingle has rows that are not linked yet
    are there pairs left.  These are verified in rounds, the most alike first,
    until none is left.
    """
    named = classes.select("node", F.col("first.doc_id").alias("_id"), F.col("first._row").alias("_at"))
    texts = hashed.select("doc_id", "_row", F.col("text").alias("_text"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = cut(nodes.distinct().join(named, "node"))
        small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS // 4 else wanted
        found = texts.join(small, (texts._row == small._at) & texts.doc_id.eqNullSafe(small._id))
        return cut(_shingle_sets(found).dropDuplicates(["node"]))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    fps = classes.select("fp0", "fp1").distinct()
    cells = _split_crowded(_to_cells(fps, max_distance, reach=True), fps, max_distance, BLOCK_ROWS)
    edges = _pairs_of(_forests(cells.repartition("cell").sortWithinPartitions("cell"), max_distance))
    # One text stands for those of a fingerprint, so marks follow fingerprints and not cells.
    stands = cut(classes.groupBy("fp0", "fp1").agg(F.min("node").alias("rep")).withColumn("fp", _node(2)))
    one, two = (stands.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    across = edges.join(one, "a").join(two, "b").select("rep_a", "rep_b")
    within = classes.join(stands, ["fp0", "fp1"]).select("node", "rep")
    tested = cut(_pairs_of(across.union(within)))
    likely = cut(_sifted(tested, classes, least))
    sets = sets_of(ends(likely))
    good = cut(_verified(likely, sets, least))
    labels = connected_components(good)

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        # A node is the two numbers in hexadecimal.
        number = lambda at: F.conv(F.substring("node", at, 16), 16, -10).cast("bigint")
        own = cut(labels.select(number(1).alias("fp2"), number(17).alias("fp3"), F.xxhash64("component").alias("label")))
        small = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
        return rows.join(small, ["fp2", "fp3"], "left").withColumn("label", F.coalesce("label", F.xxhash64("fp2", "fp3")))

    def mixed(rows: DataFrame) -> DataFrame:
        """The shingles that rows of different labels have."""
        ends = rows.groupBy("part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        return ends.where("lo <> hi").select("part")

    places = F.posexplode("first_shingles").alias("at", "part")
    keyed = labelled(classes.select("fp2", "fp3", "first_shingles"), labels).select("fp2", "fp3", "label", places)
    shared = cut(mixed(keyed))
    small = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    members = cut(keyed.join(small, "part").select("part", "fp2", "fp3", F.col("at").cast("bigint").alias("at")))
    marked = classes.select(*MARKS[2:])
    most = FIRST_PARTNERS
    while True:
        # Only where rows that share a shingle are not linked yet is there anything left to verify.
        now = labelled(members, labels)
        left = cut(now.join(mixed(now), "part").select(F.col("part").alias("cell"), "fp2", "fp3", "at", "label", F.col("part").alias("shingle")))
        near = _blocked(left).join(marked, ["fp2", "fp3"]).select("cell", *CELL)
        pairs = cut(_unlinked(near.repartition("cell").sortWithinPartitions("cell"), least, most).distinct())
        more = cut(pairs.where("a IS NULL").select(F.col("shingle").alias("part")).distinct())
        n_more = more.count()
        new = cut(_pairs_of(pairs.where("a IS NOT NULL").select("a", "b")).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(new)
        likely = cut(_sifted(new, classes, least))
        sets = sets.union(sets_of(ends(likely).join(sets, "node", "left_anti")))
        fresh = cut(_verified(likely, sets, least))
        if fresh.limit(1).count():
            good = cut(good.union(fresh))
            labels = connected_components(good)
        if not n_more:
            return labels
        members = cut(members.join(F.broadcast(more) if n_more <= BROADCAST_ROWS else more, "part", "left_semi"))
        most *= 8


def keep_one(docs: DataFrame, max_distance: int = COPY_BITS, least: float = COPY_JACCARD) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    Rows link where the Jaccard similarity of their five-word shingles is at
    least ``least``; groups are what these links connect.  Word fingerprints that
    differ in at most ``max_distance`` of 128 bits find most of these links, and
    the shingles themselves the rest, so none is lost.  Documents without words,
    null texts too, are one group: one of them stays.

    The row of the smallest ``doc_id`` stays (nulls last); of several such rows
    the one of the smallest hash of all its columns, nulls and all, and one of
    rows that are equal throughout.  Columns of any name are passed on as they are.
    """
    whole = F.struct(*[column(c) for c in docs.columns])
    hashed = docs.select("doc_id", row_hash(docs).alias("_row"), "text", whole.alias("_whole"))
    marked = cut(_marked(hashed, least))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")
    words = ["fp0", "fp1", "fp2", "fp3"]
    name = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in words[2:]])
    # Texts of one sequence of words have one sketch and one set of shingles.
    same = [*[F.min(c).alias(c) for c in MARKS[4:]], *[F.first(c).alias(c) for c in ("wide", "first_shingles")]]
    classes = cut(marked.groupBy(*words).agg(F.min(order).alias("first"), *same).withColumn("node", name))
    rooted = classes.join(_copies(classes, hashed, max_distance, least), "node", "left").select(
        *words, "first", F.coalesce("component", "node").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    best = rooted.select(*words, "root").join(named, "root").select(*words, "best")
    rows = marked.groupBy(*words, "doc_id", "_row").agg(F.count("*").alias("times")).join(best, words)
    stays = order == F.col("best")
    # What leaves the plain path: other rows of a group, and the kept row where it is repeated.
    out = cut(rows.where(~stays | (F.col("times") > 1)).select("doc_id", "_row", stays.alias("stays")))
    counts = out.agg(F.count("*").alias("n"), F.count_if("stays").alias("repeated")).first()

    def matching(side: DataFrame, n: int, how: str) -> DataFrame:
        small = F.broadcast(side) if n <= BROADCAST_ROWS else side
        return hashed.join(small, (hashed._row == side._row) & hashed.doc_id.eqNullSafe(side.doc_id), how)

    kept = matching(out, counts.n, "left_anti")
    if counts.repeated:
        kept = kept.unionByName(matching(out.where("stays"), counts.repeated, "left_semi").dropDuplicates(["doc_id", "_row"]))
    return kept.select("_whole.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes of the whole documents table."""
    return near_duplicates(read(spark, sf_dir, "documents"))
