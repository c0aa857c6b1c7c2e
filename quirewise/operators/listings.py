"""Listings, exports and reports: projections and orders over records and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import dates as D
from quirewise.functions import text as X
from quirewise.operators.graph import checkpoint
from quirewise.operators.order import spare


def counts_by(records: DataFrame, children: DataFrame, key: str, name: str = "n_rows") -> DataFrame:
    """Records with the number of their children, none counting 0; aggregated before the join."""
    counted = children.groupBy(key).agg(F.count("*").alias(name))
    return records.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def search(rows: DataFrame, column: str, needle: str, states: list[str] | None = None, state: str = "state") -> DataFrame:
    """Rows whose column holds a text in any case, of some states."""
    found = rows.where(F.contains(F.lower(column), F.lit(needle.lower())))
    return found.where(F.col(state).isin(*states)) if states else found


def page_of(rows: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page of an ordered listing; a page beyond the last gives the last.

    Rows are dealt by ranges of the order; the driver gets a count for each range,
    and only the ranges that the page lies in are numbered, however deep it is.
    """
    part, place, first_of = (spare(rows, n) for n in ("_part", "_place", "_first"))
    dealt = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    counts = sorted(tuple(r) for r in dealt.groupBy(part).agg(F.count("*")).collect())
    total = sum(n for _, n in counts)
    first = min(max(page, 0), max(0, (total - 1) // size)) * size
    wanted, before = [], 0
    for number, n in counts:
        if before < first + size and before + n > first:
            wanted.append((number, before))
        before += n
    bases = rows.sparkSession.createDataFrame(wanted, f"{part} int, {first_of} long")
    number = F.col(first_of) + F.row_number().over(Window.partitionBy(part).orderBy(*order))
    numbered = dealt.join(F.broadcast(bases), part).withColumn(place, number)  # one row a range
    return numbered.where(F.col(place).between(first + 1, first + size)).orderBy(place).select(*rows.columns)


def chronological(entries: DataFrame, key: str, order: str) -> DataFrame:
    """Entries with their place within each record's report."""
    by_date = Window.partitionBy(key).orderBy(D.parse_or_first(F.col("date")), order)
    return entries.withColumn("line", F.row_number().over(by_date))


def oldest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with their place among duplicates: oldest first, unknown dates last."""
    by_date = Window.partitionBy(key).orderBy(D.sort_key(F.col("date")), order)
    return rows.withColumn("place", F.row_number().over(by_date))


def row_tags(flag: Column, category: Column) -> Column:
    """The review marks a title carries."""
    return F.concat(F.when(flag == "x", "[ManualCheck] ").otherwise(""), F.when(category == "3", "[Diagnostic Study] ").otherwise(""))


def intro_sentence(n_pages: Column, firm: Column) -> Column:
    """The report's opening; the clause about the sender is dropped where it is blank."""
    clause = F.when(F.trim(F.coalesce(firm, F.lit(""))) != "", F.concat(F.lit(" from "), F.trim(firm))).otherwise("")
    return F.concat(F.lit("Reviewed "), n_pages.cast("string"), F.lit(" pages of records"), clause, F.lit("."))


def export_entries(summaries: DataFrame) -> DataFrame:
    """``date, title, text, start_page`` of summaries as they are exported.

    The title loses its review marks; a body whose injury prefix an edit removed
    gets the raw text's prefix back.
    """
    title = F.coalesce("edited_title", "verified_title", "title")
    body = F.coalesce("edited_text", "verified_text", "text")
    prefix = X.injury_prefix(F.col("text"))
    restored = F.when((prefix != "") & ~F.contains(body, F.lit("**DOI**")), F.concat(prefix, F.lit(" "), body)).otherwise(body)
    others = [c for c in summaries.columns if not c.endswith(("title", "text", "date"))]
    return summaries.select(
        *others, F.coalesce("edited_date", "date").alias("date"), X.export_title(title).alias("title"), restored.alias("text")
    )


def bucket_report(rows: DataFrame, bucket: str, buckets: list[str]) -> DataFrame:
    """``place, bucket, n, share`` of every bucket in a fixed order, absent ones at 0."""
    spark = rows.sparkSession
    dimension = spark.createDataFrame(list(enumerate(buckets)), f"place int, {bucket} string")
    counted = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    filled = dimension.join(counted, bucket, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = filled.agg(F.sum("n").alias("_all"))
    return filled.crossJoin(total).select(  # one row against the fixed list of buckets
        "place", bucket, "n", F.round(F.coalesce(F.try_divide(100 * F.col("n"), "_all"), F.lit(0.0)), 1).alias("share")
    )


def with_edit_marks(summaries: DataFrame) -> DataFrame:
    """Summaries with ``edited`` (any layer a person wrote) and ``verify_changed`` (an audit that ran and found something)."""
    edited = F.col("edited_title").isNotNull() | F.col("edited_date").isNotNull() | F.col("edited_text").isNotNull()
    found = F.size(F.coalesce("verify_issues", F.array().cast("array<string>"))) > 0
    return summaries.withColumn("edited", edited).withColumn("verify_changed", F.coalesce("verified", F.lit(False)) & found)


def document_listing(documents: DataFrame, jobs: DataFrame, key: str, active: tuple[str, ...], order: str) -> DataFrame:
    """Documents with ``name``, trimmed and put together, and ``active_job``: the newest active job's state and number, or null."""
    running = jobs.where(F.col("state").isin(*active)).groupBy(key).agg(F.max(F.struct(order, "state")).alias("_j"))
    name = F.trim(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))))
    return documents.withColumn("name", name).join(running, key, "left").withColumn("active_job", F.col("_j")).drop("_j")


def sort_places(rows: DataFrame, key: str, columns: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Rows with their place within each record by several columns, each up (True) or down; nulls last, then ``tie``."""
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in columns]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order, tie)))
