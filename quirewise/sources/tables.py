"""The tables of a data folder, and the views of pages and spans on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Explicit schemas for text sources (never inferred).
LABEL_SCHEMA = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PAGE_MAP_SCHEMA = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(6)])
OCR_SCHEMA = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_view(documents: DataFrame) -> DataFrame:
    """``doc_id, page, text``: every line of a document as a page, from 1."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return documents.select("doc_id", F.posexplode(lines).alias("at", "text")).select(
        "doc_id", (F.col("at") + 1).alias("page"), "text"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page view of the documents table."""
    return page_view(table(spark, sf_dir, "documents").select("doc_id", "text"))


def page_count(files: DataFrame) -> DataFrame:
    """``path, size_mb, n_pages`` of text files read as binaryFile; a form feed ends a page."""
    text = F.decode("content", "UTF-8")
    n = F.size(F.split(F.regexp_replace(text, "\f$", ""), "\f", -1))
    return files.select(
        "path", (F.col("length") / 1048576).alias("size_mb"), F.when(F.col("length") > 0, n).alias("n_pages")
    )


def _keyed(schema: T.StructType, key: str | None) -> T.StructType:
    """A schema behind a key of the record, a whole number."""
    return schema if key is None else T.StructType([T.StructField(key, T.LongType()), *schema.fields])


def read_ocr_cache(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Dense ``page, text`` rows of a JSON-lines cache; gaps are empty, the last of repeated pages wins.

    Malformed lines are skipped.  With ``key`` the cache holds many records, each
    dense up to its own last page.
    """
    by = [key] if key else []
    raw = spark.read.schema(_keyed(OCR_SCHEMA, key)).json(path).where("page >= 1")
    known = raw.withColumn("_at", F.monotonically_increasing_id()).groupBy(*by, "page").agg(F.max_by("text", "_at").alias("text"))
    every = known.groupBy(*by).agg(F.max("page").alias("n")).where("n IS NOT NULL").select(*by, F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return every.join(known, [*by, "page"], "left").select(*by, "page", F.coalesce("text", F.lit("")).alias("text"))


def done_pages(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Distinct pages already present in an append-only JSON-lines log."""
    by = [key] if key else []
    return spark.read.schema(_keyed(OCR_SCHEMA, key)).json(path).where("page IS NOT NULL").select(*by, "page").distinct()


def read_labels(spark: SparkSession, path: str, n_pages: int | None = None, key: str | None = None) -> DataFrame:
    """Spans of a ``start,end`` CSV: bad rows dropped, ends clamped to ``n_pages`` where it is given."""
    rows = spark.read.schema(_keyed(LABEL_SCHEMA, key)).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    end = F.col("end") if n_pages is None else F.least("end", F.lit(n_pages))
    return rows.where("start IS NOT NULL AND end IS NOT NULL").select(*([key] if key else []), "start", end.alias("end"))


def write_labels(starts: DataFrame, path: str, key: str = "doc_id") -> None:
    """Spans as a CSV of labels with a header."""
    starts.select(key, "start", "end").write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to an append-only JSON-lines log."""
    rows.write.mode("append").json(path)


def read_page_map(spark: SparkSession, path: str) -> DataFrame:
    """The headerless six-column page map; rows of other widths or without whole numbers are skipped."""
    rows = spark.read.text(path).select(F.split("value", ",", -1).alias("f")).where(F.size("f") == 6)
    typed = rows.select(
        F.expr("try_cast(trim(f[0]) AS INT)").alias("start"),
        F.expr("try_cast(trim(f[1]) AS INT)").alias("end"),
        *[F.trim(F.col("f")[i]).alias(n) for i, n in ((2, "category"), (3, "title"), (4, "date"), (5, "injury_date"))],
    )
    return typed.where("start IS NOT NULL AND end IS NOT NULL")


def parse_segments(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Span rows of JSON replies; an element without whole numbers is skipped, never the reply.

    Code fences are stripped, ``t`` and ``title`` mean the same, missing texts are ``-``.
    """
    bare = F.trim(F.replace(F.replace(F.col(column), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    shape = "array<struct<s:string,e:string,t:string,title:string,d:string,m:string>>"
    return replies.select("*", F.posexplode(F.from_json(bare, shape)).alias("at", "x")).select(
        *[c for c in replies.columns if c != column],
        "at",
        F.expr("try_cast(x.s AS INT)").alias("start"),
        F.expr("try_cast(x.e AS INT)").alias("end"),
        F.coalesce("x.t", "x.title", F.lit("-")).alias("title"),
        F.coalesce("x.d", F.lit("-")).alias("date"),
        F.coalesce("x.m", F.lit("-")).alias("injury_date"),
    ).where("start IS NOT NULL AND end IS NOT NULL")


def start_pages(html: DataFrame) -> DataFrame:
    """``page_id, start``: page numbers that an index page's links point to, made 1-based.

    A link names a page as ``page=N`` or ``/pN``; if any target is 0, all are counted from 0.
    """
    found = F.regexp_extract_all("html", F.lit(r'href="[^"]*?(?:page=|/p|#p)(\d{1,6})'), F.lit(1))
    numbers = F.transform(found, lambda x: x.cast("int"))
    shift = F.when(F.array_contains(numbers, 0), 1).otherwise(0)
    return html.select("page_id", F.explode(F.array_sort(F.array_distinct(numbers))).alias("n"), shift.alias("shift")).select(
        "page_id", (F.col("n") + F.col("shift")).alias("start")
    )


def human_entry_dates(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct dates of the lines ``date<TAB>…`` of human-written reports."""
    from quirewise.functions.dates import normalise

    lead = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2,4})\s*\t"
    lines = reports.select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(lead))
    parts = [F.regexp_extract("line", lead, i) for i in (1, 2, 3)]
    return lines.select(key, normalise(*parts).alias("date")).where("date IS NOT NULL").distinct()


def copy_common_columns(old: DataFrame, new_columns: list[str]) -> DataFrame:
    """The columns that both an old and a new store have, in the new order."""
    return old.select(*[c for c in new_columns if c in old.columns])
