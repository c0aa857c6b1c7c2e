"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  A word goes where a
window covers it whose words also stand in a document of a smaller ``doc_id``.

Each window is named by its minimiser, the smallest hash of the four-word pieces
in it.  Consecutive windows of one minimiser overlap in all but a word, so they
travel as one packed string to the minimiser's bucket.  There, strings whose
minimiser only one document has are passed over; the windows of the rest are
sorted by a hash, and neighbours are compared word by word, so windows are told
apart exactly.

Two things keep buckets even.  Pieces that are common in all the corpus come last
in the order that minimisers are chosen by, and a window of nothing but such
pieces is named by its own hash.  A piece counts as common where it makes up more
than a bucket's share of all pieces, so there are at most twice as many of them as
buckets.  And each unit of documents settles its own windows first: only the
windows of the smallest document that has them there travel on, so a passage that
a third of all documents share reaches its bucket once for each unit.

Rows: a null text has no words; a null ``doc_id`` is neither smaller nor larger
than any other, so its words all stay; rows of one ``doc_id`` do not remove from
each other; repeated rows each get theirs; documents of fewer words than a window
stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, map_batches, read, record_batch

WINDOW = 13
#: Words of the pieces that minimisers are chosen from.
PIECE = 4
#: Bytes of text that are settled together before their windows travel.
UNIT_BYTES = 8 << 20
#: Buckets for each shuffle partition, so that partitions are of even size.
BUCKETS_EACH = 4
#: Documents to change are broadcast up to this many (16 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
COMMON = np.uint64(1 << 63)


class Words:
    """The words of some texts: numbers that tell different words apart, hashes, and the text each stands in."""

    def __init__(self, texts: list[bytes]) -> None:
        split = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D
        self.words = list(chain.from_iterable(split))
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[self.ids]
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def whole(self, width: int) -> np.ndarray:
        """Starts of runs of ``width`` words that lie within one text."""
        if len(self.ids) < width:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.text[: len(self.text) - width + 1] == self.text[width - 1 :])

    def rolling(self, width: int) -> np.ndarray:
        """A hash of the ``width`` words from each word on."""
        total = np.zeros(max(0, len(self.ids) - width + 1), np.uint64)
        for i in range(width):
            total += self.hashes[i : i + len(total)] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64))
        total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)


def smallest_doc(words: Words, at: np.ndarray, hashes: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For each window the smallest of the ``docs`` that have its words; windows come in ascending order of ``docs``."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    rows = np.flatnonzero(same)
    alike = np.ones(len(rows), bool)
    for i in range(window):
        alike &= words.ids[at[order[rows]] + i] == words.ids[at[order[rows - 1]] + i]
    least = docs.copy()
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    least[order] = docs[order[start]]
    # Different windows of one hash, if ever there are any, are told apart by their words.
    for low in np.unique(start[rows[~alike]]):
        group = order[np.flatnonzero(start == low)]
        _, kind = np.unique(words.ids[at[group][:, None] + np.arange(window)], axis=0, return_inverse=True)
        for k in range(kind.max() + 1):
            least[group[kind.ravel() == k]] = docs[group[kind.ravel() == k]].min()
    return least


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def runs(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``at`` of the first and the last of consecutive windows that share all of ``same``."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.diff(at) != 1
    for values in same:
        new |= values[1:] != values[:-1]
    first = np.concatenate(([0], np.flatnonzero(new) + 1))
    return first, np.concatenate((first[1:] - 1, [len(at) - 1]))


def units(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc ids, text hashes, texts) of documents in ascending order of ids, ``UNIT_BYTES`` of text at a time."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        docs, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sizes = np.cumsum([len(t) for t in texts])
        for unit in np.unique(sizes // UNIT_BYTES):
            here = np.flatnonzero(sizes // UNIT_BYTES == unit)
            here = here[np.argsort(docs[here], kind="stable")]
            yield docs[here], marks[here], [texts[i] for i in here]


def pack(docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, names: np.ndarray, body: bytes) -> bytes:
    """One bucket's strings from one unit: columns, then the strings end to end."""
    columns = [docs.astype("<i8"), marks.astype("<i8"), starts.astype("<i8"), sizes.astype("<i4"), names.astype("<u4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(docs).to_bytes(8, "little"), *[c.tobytes() for c in columns], body]))


def unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, columns = int.from_bytes(raw[:8], "little"), 8, []
    for kind, width in (("<i8", 8), ("<i8", 8), ("<i8", 8), ("<i4", 4), ("<u4", 4)):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * width
    return columns, raw[at:]


def common_pieces(rows: DataFrame, buckets: int, piece: int) -> np.ndarray:
    """Hashes of the pieces that make up more than a bucket's share of all, sorted.

    A unit names those that make up half of that share in it.  What it leaves out
    is less than half of the share of all units together, so no common one is lost,
    and at most ``2 * buckets`` pieces can reach the sum that is asked for.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in units(batches):
            words = Words(texts)
            at = words.whole(piece)
            found, n = np.unique(words.rolling(piece)[at], return_counts=True)
            often = n >= len(at) / (2 * buckets)
            yield record_batch(
                piece=([*found[often].view(np.int64).tolist(), None], pa.int64()), n=([*n[often].tolist(), len(at)], pa.int64())
            )

    bound_batches(rows.sparkSession)
    sums = rows.mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    total = sums.where("piece IS NULL").first()
    if total is None:
        return np.empty(0, np.uint64)
    found = sums.where("piece IS NOT NULL").where(F.col("n") >= total.n / (2 * buckets)).collect()
    return np.sort(np.array([r.piece for r in found], np.int64).view(np.uint64))


def super_kmers(words: Words, at: np.ndarray, hashes: np.ndarray, common: np.ndarray, window: int, piece: int) -> np.ndarray:
    """The minimiser of each window in ``at``."""
    pieces = words.rolling(piece)
    ranks = pieces >> np.uint64(1)
    if len(common):
        place = np.minimum(np.searchsorted(common, pieces), len(common) - 1)
        ranks = np.where(common[place] == pieces, ranks | COMMON, ranks)
    names = sliding_least(ranks, window - piece + 1)[at]
    return np.where(names >= COMMON, hashes, names)


def _travel(rows: DataFrame, buckets: int, common: np.ndarray, window: int, piece: int) -> DataFrame:
    """``bucket, settled, blob``: packed strings for the buckets, and spans that units settle by themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, marks, texts in units(batches):
            words = Words(texts)
            at = words.whole(window)
            if not len(at):
                continue
            hashes = words.rolling(window)[at]
            text = words.text[at]
            own = docs[text]
            settled = smallest_doc(words, at, hashes, own, window) < own
            out: list[tuple[int, bool, bytes]] = []
            if settled.any():
                here, place = at[settled], text[settled]
                a, b = runs(here, place)
                blob = pack(docs[place[a]], marks[place[a]], here[a] - words.first[place[a]], b - a + 1, np.zeros(len(a)), b"")
                out.append((int(hashes[0] % np.uint64(buckets)), True, blob))
            names = super_kmers(words, at, hashes, common, window, piece)[~settled]
            here, place = at[~settled], text[~settled]
            a, b = runs(here, place, names)
            names, starts, lasts, place = names[a], here[a], here[b] + window - 1, place[a]
            joined = b" ".join(words.words)
            ends = np.cumsum(np.fromiter(map(len, words.words), np.int64, len(words.words)) + 1) - 1
            low = np.where(starts > 0, ends[starts - 1] + 1, 0)
            high = ends[lasts]
            bucket = ((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)):
                mine = order[edges[p] : edges[p + 1]]
                body = b"".join([joined[x:y] for x, y in zip(low[mine].tolist(), high[mine].tolist(), strict=True)])
                where = place[mine]
                blob = pack(docs[where], marks[where], starts[mine] - words.first[where], high[mine] - low[mine], names[mine] & np.uint64(0xFFFFFFFF), body)
                out.append((int(p), False, blob))
            for i in range(0, len(out), 256):
                yield record_batch(
                    bucket=([x[0] for x in out[i : i + 256]], pa.int32()),
                    settled=([x[1] for x in out[i : i + 256]], pa.bool_()),
                    blob=([x[2] for x in out[i : i + 256]], pa.binary()),
                )

    return rows.mapInArrow(run, "bucket int, settled boolean, blob binary")


def _spans(docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(x.astype(np.int64)) for x in (docs, marks, starts, sizes)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "start", "n"])


def bucket_spans(blobs: list[bytes], window: int) -> pa.RecordBatch | None:
    """The repeated windows of a bucket, as runs within documents."""
    found = [unpack(b) for b in blobs]
    docs, marks, starts, sizes, names = (np.concatenate(x) for x in zip(*[f[0] for f in found], strict=True))
    order = np.argsort(names, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], names[order][1:] != names[order][:-1])))
    mixed = np.minimum.reduceat(docs[order], edge) < np.maximum.reduceat(docs[order], edge)
    shared = np.zeros(len(docs), bool)
    shared[order] = np.repeat(mixed, np.diff(np.concatenate((edge, [len(order)]))))
    mine = np.flatnonzero(shared)
    if not len(mine):
        return None
    mine = mine[np.argsort(docs[mine], kind="stable")]
    body = b"".join(f[1] for f in found)
    high = np.cumsum(sizes, dtype=np.int64)
    low = high - sizes
    words = Words([body[x:y] for x, y in zip(low[mine].tolist(), high[mine].tolist(), strict=True)])
    at = words.whole(window)
    text = words.text[at]
    own = docs[mine][text]
    again = smallest_doc(words, at, words.rolling(window)[at], own, window) < own
    at, text = at[again], text[again]
    a, b = runs(at, text)
    if not len(a):
        return None
    where = mine[text[a]]
    return _spans(docs[where], marks[where], starts[where] + at[a] - words.first[text[a]], b - a + 1)


def _settle(travelled: DataFrame, window: int) -> DataFrame:
    """``doc_id, mark, start, n``: ``n`` repeated windows from word ``start`` on; ``travelled`` comes bucket by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, settled, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if settled:
                    (docs, marks, starts, sizes, _), _ = unpack(blob)
                    yield _spans(docs, marks, starts, sizes)
                    continue
                if bucket != now:
                    if held and (out := bucket_spans(held, window)) is not None:
                        yield out
                    now, held = bucket, []
                held.append(blob)
        if held and (out := bucket_spans(held, window)) is not None:
            yield out

    return travelled.mapInArrow(run, "doc_id bigint, mark bigint, start bigint, n bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``doc_id, mark, start, n``: windows of a document that a document of a smaller id has too.

    ``mark`` is the text's ``xxhash64``; ``start`` counts words from 0, and ``n``
    windows start there and at the words that follow.
    """
    rows = _keyed(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "mark", "text")
    bound_batches(docs.sparkSession)
    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = common_pieces(rows, buckets, piece)
    travelled = _travel(rows, buckets, common, window, piece)
    return _settle(travelled.repartition("bucket").sortWithinPartitions("bucket"), window)


def without_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; ``kept`` are the words that stay, joined by one space."""
    spans = cut(repeated_windows(docs, window, piece).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    rows = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, kept = [], [], []
        marked = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), marked, strict=True):
            words = text.split()
            sizes.append(len(words))
            if own:
                change = np.zeros(len(words) + 1, np.int64)
                starts = np.array([s["start"] for s in own])
                np.add.at(change, starts, 1)
                np.add.at(change, starts + np.array([s["n"] for s in own]) + window - 1, -1)
                words = [w for w, covered in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not covered]
            gone.append(sizes[-1] - len(words))
            kept.append(b" ".join(words))
        made = record_batch(n_words=(sizes, pa.int64()), n_removed=(gone, pa.int64()))
        text = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *made.columns, text], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept string"
    keys = spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    same = (rows.doc_id.cast("bigint") == F.col("_id")) & (rows.mark == F.col("_mark"))
    if spans.count() > BROADCAST_ROWS:
        joined = rows.join(spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans"), same, "left")
        return map_batches(joined.select("doc_id", "text", "spans"), per_batch, schema)
    # Only the texts that lose words travel to their spans.
    clean = rows.join(F.broadcast(keys), same, "left_anti").select("doc_id", "text")
    marked = rows.join(F.broadcast(keys), same, "left_semi").withColumn("_id", F.col("doc_id").cast("bigint"))
    marked = marked.join(spans.select(F.col("doc_id").alias("_id"), "mark", "spans"), ["_id", "mark"]).select("doc_id", "text", "spans")
    return map_batches(clean, per_batch, schema).unionByName(map_batches(marked, per_batch, schema))


def op12_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table without passages of 13 words that documents before have."""
    kept = without_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL: every window of every document, and the smallest document that has it.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL
), windows AS (
  SELECT r, doc_id, s, array_to_string(w[s : s + 12], ' ') AS words FROM starts
), repeated AS (
  SELECT r, s FROM (SELECT r, doc_id, s, min(doc_id) OVER (PARTITION BY words) AS first FROM windows) WHERE first < doc_id
), covered AS (
  SELECT DISTINCT r, s + unnest(range(0, 13)) AS p FROM repeated
), gone AS (
  SELECT r, list(p) AS ps, count(*) AS n FROM covered GROUP BY r
), placed AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE r IN (SELECT r FROM gone)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
