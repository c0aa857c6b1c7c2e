"""Span algebra on ordered pages.  Spans are inclusive and 1-based: two integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quirewise.columns import extended
from quirewise.operators.graph import checkpoint
from quirewise.operators.order import by_key, running_sums, spare
from quirewise.session import ship


def tile(starts: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, end``: spans that tile 1..n from start pages (repeats and strays dropped).

    ``sizes`` gives ``key, n``; a record without starts has no spans.
    """
    kept = starts.join(sizes, key).where("start BETWEEN 1 AND n").select(key, "start", "n").distinct()
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return kept.select(key, "start", F.coalesce(after - 1, "n").alias("end"))


def sizes_of(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n``: the number of pages of each record."""
    return pages.groupBy(key).agg(F.max("page").alias("n"))


def next_start(start: str, end: str, overlap: int) -> Column:
    """Where the window after ``start..end`` begins: it moves on, and overlaps by a third at most."""
    start, end = F.col(start), F.col(end)
    shared = F.least(F.lit(overlap), F.greatest(F.lit(1), F.floor((end - start + 1) / 3)))
    return F.greatest(start + 1, end - shared + 1)


def _numbered(pages: DataFrame, budget: int, most: int, key: str) -> DataFrame:
    """``key, top, s, e, first, last``: of every page, numbered over all records, the last page of a window from there.

    A window holds the pages whose running sum of bytes is at most that before its
    first page plus the budget.  Sums and bounds are merged in one order, so the
    pages up to a bound are a running count.
    """
    rows = pages.select(key, F.struct(key, "page").alias("_o"), F.col("bytes").cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("s"))
    summed = running_sums(rows, "_o", ["bytes", "s"]).select(key, "bytes", F.col("bytes_upto").alias("v"), F.col("s_upto").alias("s"))
    records = summed.groupBy(key).agg(F.min("s").alias("first"), F.max("s").alias("last"), F.max("bytes").alias("top"))
    pages_ = summed.join(records, key).select(key, "top", "s", "first", "last", "v", F.lit(1).cast("bigint").alias("is_page"), "bytes")
    bounds = pages_.withColumns({"v": F.col("v") - F.col("bytes") + budget, "is_page": F.lit(0).cast("bigint")})
    both = pages_.unionByName(bounds).withColumn("_o", F.struct("v", -F.col("is_page"), "s"))
    counted = running_sums(both, "_o", ["is_page"]).where("is_page = 0")
    return counted.select(key, "top", "s", F.least("is_page_upto", F.col("s") + (most - 1), "last").alias("e"), "first", "last")


def budget_windows(pages: DataFrame, overlap: int, budget: int, most: int, key: str = "doc_id") -> DataFrame:
    """``key, k, start, end``: windows of at most ``budget`` bytes and ``most`` pages.

    ``pages`` gives ``key, page, bytes``; pages count from 1 in their order.  Each
    window starts where the one before it says.  So every page points at the start
    of the window after its own, and partitions of consecutive pages follow these
    pointers to where they leave the partition.  Where a record goes on through
    several partitions, these exits are followed by doubling: exits of exits, until
    all lie behind the record.  Then each partition knows where it is entered, and
    walks from there.  No task holds a record, only a partition of pages.

    A record with a page over the budget has one row with ``k`` = -1 and no span.
    ``overlap`` 0 gives windows that do not overlap.
    """
    if most < 1:
        raise ValueError("a window holds one page at least")
    ship(pages.sparkSession)
    numbered = checkpoint(_numbered(pages, budget, most, key))
    over = numbered.where((F.col("top") > budget) & (F.col("s") == F.col("first"))).select(
        key, F.lit(-1).alias("k"), *[F.lit(None).cast("int").alias(c) for c in ("start", "end")]
    )
    follows = next_start("s", "e", overlap) if overlap else F.col("e") + 1
    good = numbered.where(F.col("top") <= budget).withColumn("next", F.when(F.col("e") < F.col("last"), follows))
    order = ["s", "e", "next", "first", "last"]
    dealt = checkpoint(good.select(key, *order).repartitionByRange("s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id()))

    def exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["part", "s", "next"]):
            place = np.array(rows["s"], np.int64)
            goes = np.array([x or 0 for x in rows["next"]], np.int64)
            hops = (goes > 0).astype(np.int64)
            # The pointers double until each leaves the partition or the record.
            while True:
                at = np.minimum(np.searchsorted(place, goes), len(place) - 1)
                inside = (goes > 0) & (place[at] == goes)
                if not inside.any():
                    break
                here = np.flatnonzero(inside)
                hops[here] += hops[at[here]]
                goes[here] = goes[at[here]]
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(goes, mask=goes == 0), pa.array(hops)], names=["s", "exit", "hops"])

    leaves = checkpoint(dealt.select("part", "s", "next").mapInArrow(exits, "s bigint, exit bigint, hops bigint").where("exit IS NOT NULL"))
    firsts = dealt.where(F.col("s") == F.col("first")).select("s", F.lit(0).cast("bigint").alias("k"))
    # Only pages that some pointer from another partition reaches matter from here on: a window's reach at each partition's start.
    wanted = leaves.select(F.col("exit").alias("s")).distinct()
    jumps = checkpoint(leaves.join(wanted, "s"))
    reached = checkpoint(firsts.join(leaves, "s").select(F.col("exit").alias("s"), (F.col("k") + F.col("hops")).alias("k")))
    while jumps.limit(1).count():
        more = reached.join(jumps, "s").select(F.col("exit").alias("s"), (F.col("k") + F.col("hops")).alias("k"))
        reached = checkpoint(reached.union(more))
        then = jumps.select(F.col("s").alias("exit"), F.col("exit").alias("exit2"), F.col("hops").alias("hops2"))
        jumps = checkpoint(jumps.join(then, "exit").select("s", F.col("exit2").alias("exit"), (F.col("hops") + F.col("hops2")).alias("hops")))
    # At most one record goes on into a partition, so there is at most one entry for each.
    entries = dict(map(tuple, reached.collect()))
    kind = pages.schema[key]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["first", key, *order[:3]]):
            place, first, out = rows["s"], rows["first"][0], []
            at, k = (place[0], entries.get(place[0], 0)) if place[0] == first else next(((s, entries[s]) for s in place if s in entries), (None, 0))
            while at is not None and place[0] <= at <= place[-1]:
                i = at - place[0]
                out.append((k, at - first + 1, rows["e"][i] - first + 1))
                at, k = rows["next"][i], k + 1
            if out:
                ids = pa.array(rows[key][:1] * len(out), batch_type)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int32()) for c in zip(*out, strict=True)]], names=[key, "k", "start", "end"])

    batch_type = to_arrow_type(kind.dataType)
    found = dealt.select("first", key, *order[:3]).mapInArrow(walk, extended([kind], k=T.IntegerType(), start=T.IntegerType(), end=T.IntegerType()))
    return found.unionByName(over)


def fixed_windows(sizes: DataFrame, window: int, overlap: int, key: str = "doc_id") -> DataFrame:
    """``key, k, start, end``: windows of a fixed number of pages, up to the first that reaches the end."""
    step = window - overlap
    last = F.when(F.col("n") <= window, 1).otherwise(F.ceil((F.col("n") - window) / step) * step + 1)
    starts = sizes.select(key, "n", F.posexplode(F.sequence(F.lit(1), last.cast("int"), F.lit(step))).alias("k", "start"))
    return starts.select(key, "k", "start", F.least(F.col("start") + window - 1, F.col("n")).alias("end"))


def chunk_grid(sizes: DataFrame, chunk: int, key: str = "doc_id") -> DataFrame:
    """``key, k, start, end``: chunks that do not overlap."""
    return fixed_windows(sizes, chunk, 0, key)


def ownership_merge(reports: DataFrame, windows: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merge the rows that overlapping windows report into spans that tile the record.

    ``reports`` gives ``key, k, pos, start, title``.  Window k owns the starts
    after its own first page up to the next window's first page; the first window
    owns from 1, the last to the end.  The first window wins a start that two
    report.  A record whose first page starts nothing gets a flagged row there.
    """
    by_window = Window.partitionBy(key).orderBy("k")
    owned = windows.join(sizes, key).select(
        key,
        "k",
        F.when(F.col("k") == 0, 0).otherwise(F.col("start")).alias("floor"),
        F.coalesce(F.lead("start").over(by_window), "n").alias("cap"),
    )
    kept = reports.join(owned, [key, "k"]).where("start > floor AND start <= cap")
    first = F.row_number().over(Window.partitionBy(key, "start").orderBy("k", "pos"))
    rows = kept.withColumn("_n", first).where("_n = 1").select(key, "start", "title", F.lit("").alias("flag"))
    led = rows.where("start = 1").select(key)
    opening = sizes.join(led, key, "left_anti").select(key, F.lit(1).alias("start"), F.lit("-").alias("title"), F.lit("x").alias("flag"))
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return (
        rows.unionByName(opening)
        .join(sizes, key)
        .select(key, "start", F.coalesce(after - 1, "n").alias("end"), "title", "flag")
    )


def overlap_vote(reports: DataFrame, windows: DataFrame, tolerance: int = 2, key: str = "doc_id") -> DataFrame:
    """Reports without those in an overlap that the window before does not confirm within ``tolerance`` pages."""
    before = F.lag("end").over(Window.partitionBy(key).orderBy("k"))
    marked = reports.join(windows.select(key, "k", before.alias("_until")), [key, "k"])
    seen = reports.select(
        key, (F.col("k") + 1).alias("k"), F.explode(F.sequence(F.col("start") - tolerance, F.col("start") + tolerance)).alias("start")
    ).distinct()
    shared = marked.where("start <= _until").join(seen, [key, "k", "start"], "left_semi")
    own = marked.where("_until IS NULL OR start > _until")
    return own.unionByName(shared).drop("_until")


def fold_islands(rows: DataFrame, joins: Column, key: str, order: str, group: str = "island") -> DataFrame:
    """``key, island`` with span, first title and flag of runs of rows that fold together.

    A row for which ``joins`` holds folds into the row before it, whatever that
    one became; a record's first row never does.
    """
    by_row = Window.partitionBy(key).orderBy(order)
    breaks = F.when((F.row_number().over(by_row) == 1) | ~F.coalesce(joins, F.lit(False)), 1).otherwise(0)
    marked = rows.withColumn("_break", breaks)
    numbered = marked.withColumn(group, F.sum("_break").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, group).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("title", order).alias("title"),
        F.max(F.when(F.col("flag") == "x", "x").otherwise("")).alias("flag"),
        F.count("*").alias("n_rows"),
    )


def mark_suggestions(rows: DataFrame, refuted: Column, key: str, order: str) -> DataFrame:
    """Rows with ``suggest_merge``: refuted, but never a record's first."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_at", at).withColumn("suggest_merge", F.coalesce(refuted, F.lit(False)) & (F.col("_at") > 1)).drop("_at")


def suspects(rows: DataFrame, cap: int, key: str, order: str) -> DataFrame:
    """Boundaries worth a second look: rows that resemble the one before, or are short, first; ``cap`` a record."""
    by_row = Window.partitionBy(key).orderBy(order)
    alike = (F.lag("category").over(by_row) == F.col("category")) & (F.lag("date").over(by_row) == F.col("date")) & (F.col("date") != "-")
    short = (F.col("end") - F.col("start")) < 2
    marked = rows.select("*", F.row_number().over(by_row).alias("_at"), F.coalesce(alike | short, F.lit(False)).alias("triggered")).where("_at > 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("triggered").desc(), order))
    return marked.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_at", "_rank")


def span_pages(spans: DataFrame, margin: int = 0) -> DataFrame:
    """One row for each page of each span, widened by ``margin`` pages."""
    return spans.withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("start") - margin), F.col("end") + margin)))


def split_at(rows: DataFrame, at: Column) -> DataFrame:
    """Rows cut in two where ``start < at <= end``; the second half is untitled and flagged."""
    inside = F.coalesce((at > F.col("start")) & (at <= F.col("end")), F.lit(False))
    whole = F.struct("start", "end", "title", "flag")
    halves = F.array(
        F.struct(F.col("start"), (at - 1).cast("int").alias("end"), F.col("title"), F.col("flag")),
        F.struct(at.cast("int").alias("start"), F.col("end"), F.lit("-").alias("title"), F.lit("x").alias("flag")),
    )
    others = [c for c in rows.columns if c not in ("start", "end", "title", "flag")]
    return rows.select(*others, F.explode(F.when(inside, halves).otherwise(F.array(whole))).alias("_s")).select(*others, "_s.*")


def coverage(spans: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, gaps, overlaps``: pages in no span, and in more than one."""
    times = span_pages(spans).groupBy(key, "page").agg(F.count("*").alias("times"))
    every = sizes.select(key, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"))
    return every.join(times, [key, "page"], "left").groupBy(key).agg(
        F.count_if(F.col("times").isNull()).alias("gaps"), F.count_if(F.col("times") > 1).alias("overlaps")
    )


def running_ranges(files: DataFrame, group: str, order: str) -> DataFrame:
    """Running 1-based page ranges of files put together; files without pages are skipped.

    Sums run over all groups by ranges of the order, and each group takes off what
    was before its first file, so a group of very many files is no one task.
    """
    kept = files.where("n_pages > 0")
    place, base, own = (spare(kept, n) for n in ("_o", "_base", "_group"))
    summed = running_sums(kept.withColumn(place, F.struct(group, order)), place, ["n_pages"])
    before = summed.groupBy(F.col(group).alias(own)).agg(F.min(F.col("n_pages_upto") - F.col("n_pages")).alias(base))
    joined = summed.join(before, summed[group].eqNullSafe(before[own]))
    end = F.col("n_pages_upto") - F.col(base)
    return joined.select(*files.columns, end.alias("end"), (end - F.col("n_pages") + 1).alias("start"))
