"""Operators on a record's pages: assembling texts, and cues for where spans start."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.columns import extended, map_arrow
from quirewise.functions import text as X
from quirewise.functions.pictures import difference_hashes
from quirewise.functions.ratios import ratio
from quirewise.session import ship


def page_sizes(pages: DataFrame) -> DataFrame:
    """Pages with their bytes."""
    return pages.withColumn("bytes", F.octet_length("text"))


def assemble(spans_pages: DataFrame, key: list[str], marked: bool = False, offset: Column | int = 0) -> DataFrame:
    """``key, text, pages, errored, blank`` of spans from rows of ``key, page, text, ok``.

    Pages come in ascending order and once each; failed pages are reported and
    left out of the text.  ``marked`` opens each page with its number plus ``offset``.
    """
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    rows = spans_pages.withColumn("_no", F.col("page") + shift).select(*key, "page", "_no", "text", "ok").distinct()
    item = F.concat(F.lit("Page "), F.col("_no").cast("string"), F.lit(":\n"), "text") if marked else F.col("text")
    ordered = lambda when, value: F.transform(
        F.array_sort(F.collect_list(F.when(when, F.struct(F.col("page").alias("p"), value.alias("v"))))), lambda x: x["v"]
    )
    page = F.col("page").cast("string")
    blank = F.col("ok") & (F.trim("text") == "")
    return rows.groupBy(*key).agg(
        F.array_join(ordered(F.col("ok"), item), "\n").alias("text"),
        F.count("*").alias("pages"),
        F.array_join(ordered(~F.col("ok"), page), ",").alias("errored"),
        F.array_join(ordered(blank, page), ",").alias("blank"),
    )


def escalation_text(spans_pages: DataFrame, key: list[str], most_pages: int = 3, most_chars: int = 12_000) -> DataFrame:
    """``key, text``: the first pages of a span until there is enough to decide by; blank pages are skipped."""
    first = Window.partitionBy(*key).orderBy("page")
    near = spans_pages.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most_pages).where(F.trim("text") != "")
    before = F.coalesce(F.sum(F.length("text") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = near.withColumn("_before", before).where(F.col("_before") < most_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy(*key).agg(F.left(joined, F.lit(most_chars)).alias("text"))


def counter_starts(pages: DataFrame, broad: bool = False) -> DataFrame:
    """``doc_id, start``: pages where the printed counter restarts or its total changes.

    Compared with the last page that carried a counter; page 1 always starts.
    """
    by_page = Window.partitionBy("doc_id").orderBy("page")
    seen = pages.withColumn("_c", X.page_counter(F.col("text"), broad))
    last = F.last("_c", ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, -1))
    marked = seen.withColumn("_p", last)
    x, y = F.col("_c.x"), F.col("_c.y")
    reset = F.when(F.col("_p").isNull(), x == 1).otherwise((x == 1) | (x <= F.col("_p.x")) | (y != F.col("_p.y")))
    return marked.where((F.col("page") == 1) | (F.col("_c").isNotNull() & reset)).select("doc_id", F.col("page").alias("start"))


def after_blank(pages: DataFrame) -> DataFrame:
    """``doc_id, start``: pages that follow a blank one."""
    before = F.lag(F.trim("text") == "").over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.withColumn("_b", before).where("_b").select("doc_id", F.col("page").alias("start"))


def similarity(rows: DataFrame, a: str, b: str, name: str, both_empty: float | None = 1.0, cuts: tuple[float, ...] = ()) -> DataFrame:
    """Rows with the matching-block ratio of two text columns (null where one is), or with ``cuts`` what compares alike with each.

    The ratio has no built-in twin: blocks are found longest first, so the
    argument order matters.  Computed on Arrow batches.
    """
    ship(rows.sparkSession)
    schema = extended(rows.schema, **{name: T.DoubleType()})

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return both_empty
        return ratio(x, y, cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)
            ratios = pa.array([one(x, y) for x, y in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ratios], names=[*batch.schema.names, name])

    return map_arrow(rows, run, schema)


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages dealt by record over as many parts as shuffles have: small rows may be much work, so parts are not joined by size."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def band_starts(pages: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``doc_id, start``: pages whose header and footer differ sharply from the page before."""
    banded = _dealt(pages.select("doc_id", "page", X.band(F.col("text")).alias("band")))
    before = F.lag("band").over(Window.partitionBy("doc_id").orderBy("page"))
    pairs = banded.withColumn("before", before).where("page > 1 AND band <> '' AND before <> ''")
    changed = similarity(pairs, "before", "band", "ratio", cuts=(threshold,)).where(F.col("ratio") < threshold)
    return banded.where("page = 1").select("doc_id", F.col("page").alias("start")).union(changed.select("doc_id", "page"))


def page_hashes(pages: DataFrame, most_chars: int = 1_000_000) -> DataFrame:
    """Pages with ``hash``: 64 bits of the picture that each text makes; a task sets that many characters at a time, or one page."""
    ship(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made, some, size = [], [], 0
            for text in texts:
                if some and size + len(text) > most_chars:
                    made.append(difference_hashes(some))
                    some, size = [], 0
                some.append(text)
                size += len(text)
            if some:
                made.append(difference_hashes(some))
            hashes = pa.chunked_array([pa.array(h) for h in made], pa.int64()).combine_chunks()
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=[*batch.schema.names, "hash"])

    return map_arrow(pages, run, extended(pages.schema, hash=T.LongType()))


def transition_features(pages: DataFrame) -> DataFrame:
    """Per page and its predecessor: what counters, dates and sizes say about a start between them.

    1 speaks for a start, -1 against, 0 is no evidence.  The first printed counter of
    a page counts, wherever it stands.  Where pages have a ``hash``, both are kept.
    """
    kept = [c for c in ("hash",) if c in pages.columns]
    counter = r"(?i)page\s{0,2}(\d{1,3})\s{0,2}(?:of|/)\s{0,2}(\d{1,4})"
    seen = pages.select(
        "doc_id", "page",
        F.regexp_extract("text", counter, 1).try_cast("int").alias("x"),
        F.regexp_extract("text", counter, 2).try_cast("int").alias("y"),
        X.date_tokens(F.col("text")).alias("dates"), F.octet_length("text").alias("bytes"),
        X.heading(F.col("text")).alias("heading"), X.banner(F.col("text")).alias("banner"), *kept,
    )
    by_page = Window.partitionBy("doc_id").orderBy("page")
    both = _dealt(seen).withColumns({f"_{c}": F.lag(c).over(by_page) for c in ("dates", "bytes", "heading", "banner", *kept)}).where("page > 1")
    counted = (F.col("x") >= 1) & (F.col("y") >= F.col("x"))
    change = F.abs(F.col("bytes") - F.col("_bytes")) / F.greatest("bytes", "_bytes", F.lit(1))
    return both.select(
        "doc_id", "page", "heading", "_heading", "banner", "_banner", *kept, *[f"_{c}" for c in kept],
        F.when(counted, F.when(F.col("x") == 1, 1).otherwise(-1)).otherwise(0).alias("pagenum"),
        F.when(F.arrays_overlap("dates", "_dates"), -1)
        .when((F.size("dates") > 0) & (F.size("_dates") > 0), 1).otherwise(0).alias("dates"),
        F.when(change >= 0.5, 1).otherwise(0).alias("bytes"),
    )


def transition_signals(pages: DataFrame) -> DataFrame:
    """The transition features with what heading, banner and picture say, by their similarity.

    ``pages`` may bring ``hash``, 64 bits of each page's picture, null where there is
    none; else pages are set from their texts.  Pictures are alike up to 8 bits, and
    24 or more speak for a start.
    """
    base = transition_features(pages if "hash" in pages.columns else page_hashes(pages))
    rated = similarity(base, "heading", "_heading", "_h", cuts=(0.35, 0.75))
    rated = similarity(rated, "banner", "_banner", "_b", cuts=(0.7,))
    both = (F.col("heading") != "") & (F.col("_heading") != "")
    head = F.when(~both, 0).when(F.col("_h") >= 0.75, -1).when(F.col("_h") <= 0.35, 1).otherwise(0)
    known = (F.col("banner") != "") & (F.col("_banner") != "")
    flag = F.when(F.coalesce(~known, F.lit(True)), 0).when(F.col("_b") >= 0.7, -1).otherwise(1)
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("_hash")))
    picture = F.when(apart <= 8, -1).when(apart >= 24, 1).otherwise(0)
    return rated.select("doc_id", "page", "pagenum", flag.alias("banner"), head.alias("header"), "dates", "bytes", picture.alias("phash"))


def counter_offset(readings: DataFrame, key: str, size: int) -> DataFrame:
    """``key, offset``: printed number minus place, where two readings at least agree; ties go to the first seen, then the smallest.

    ``readings`` gives ``key, i, printed`` with places 1..``size``.
    """
    good = readings.where((F.col("i") >= 1) & (F.col("i") <= size) & (F.col("printed") >= 1))
    counted = good.groupBy(key, (F.col("printed") - F.col("i")).alias("offset")).agg(F.count("*").alias("n"), F.min("i").alias("first"))
    best = counted.groupBy(key).agg(F.max_by(F.struct("offset", "n"), F.struct("n", -F.col("first"), -F.col("offset"))).alias("_b"))
    return readings.select(key).distinct().join(best, key, "left").select(key, F.when(F.col("_b.n") >= 2, F.col("_b.offset")).alias("offset"))
