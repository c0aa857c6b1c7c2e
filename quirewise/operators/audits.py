"""Where a row's date is written: an index of the dates on all pages, joined by equality.

Rows: a null page text has no dates; a date that is null, unknown or no full
``MM/DD/YYYY`` has nothing to check; repeated rows each get theirs; a page beyond
the record is on no page; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions import dates as D
from quirewise.operators.graph import checkpoint
from quirewise.operators.order import spare

#: Dates as they are read off a page, at every place where one may begin; years of two or four digits.
_SEPARATED = r"(?<![0-9])(?=0?([1-9][0-9]?)\s?[/.-]\s?0?([0-9]{1,2})\s?[/.-]\s?([0-9]{4}|[0-9]{2})(?![0-9]))"
_SPELLED = r"(?i)(" + "|".join(D.MONTHS) + r")\s+0?([0-9]{1,2}),?\s+([0-9]{4})"


def _parts(text: Column, pattern: str) -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate("mdy", 1)]
    return F.arrays_zip(*found)


def date_postings(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, page, m, d, yy, y, spelled``: each different date of a page; ``y`` is null where the year has two digits."""
    text = F.coalesce("text", F.lit(""))
    months = F.array(*[F.lit(m.lower()) for m in D.MONTHS])
    number = lambda x: x.cast("int")

    def posting(x: Column, month: Column, spelled: bool) -> Column:
        year = F.when(F.length(x["y"]) == 4, number(x["y"]))
        return F.struct(month.alias("m"), number(x["d"]).alias("d"), number(F.substring(x["y"], -2, 2)).alias("yy"), year.alias("y"), F.lit(spelled).alias("spelled"))

    written = F.transform(_parts(text, _SEPARATED), lambda x: posting(x, number(x["m"]), False))
    named = F.transform(_parts(text, _SPELLED), lambda x: posting(x, F.array_position(months, F.lower(x["m"])).cast("int"), True))
    return pages.select(key, "page", F.explode(F.array_distinct(F.concat(written, named))).alias("_p")).select(key, "page", "_p.*")


def date_in_source(rows: DataFrame, pages: DataFrame, margin: int = 2, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``bucket``: in the row, within ``margin`` pages, elsewhere in the record, or nowhere.

    ``rows`` gives ``key, start, end, date, summarized``; ``pages`` ``key, page,
    text``.  Rows meet the dates of their own pages by equality, so a date that
    every page bears makes no more rows than there are pages.  A date that is
    nowhere, of a row that is not summarised, never shipped; one whose month and
    year stand in the row with another day differs by day.
    """
    row = spare(rows, "_row")
    at = F.split("date", "/")
    piece = lambda i: F.get(at, F.lit(i)).try_cast("int")
    known = D.is_checkable(F.col("date"))
    asked = checkpoint(rows.withColumn(row, F.monotonically_increasing_id()))
    wanted = asked.where(known).select(row, key, "start", "end", piece(0).alias("m"), piece(1).alias("d"), piece(2).alias("year"), (piece(2) % 100).alias("yy"))
    postings = date_postings(pages, key)
    same_year = F.col("y").isNull() | (F.col("y") == F.col("year"))
    own = wanted.withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("start") - margin), F.col("end") + margin)))
    inside = F.col("page").between(F.col("start"), F.col("end"))
    dates = postings.select(key, "page", "m", "d", "yy", "y").distinct()
    near = own.join(dates, [key, "page", "m", "d", "yy"]).where(same_year).groupBy(row).agg(F.bool_or(inside).alias("_in"))
    anywhere = wanted.join(dates.select(key, "m", "d", "yy", "y").distinct(), [key, "m", "d", "yy"]).where(same_year).select(row).distinct()
    months = postings.where("NOT spelled").select(key, "page", "m", "yy", "y").distinct()
    other_day = own.where(inside).join(months, [key, "page", "m", "yy"]).where(same_year).select(row).distinct()
    marked = (
        asked.join(near, row, "left")
        .join(anywhere.withColumn("_any", F.lit(True)), row, "left")
        .join(other_day.withColumn("_month", F.lit(True)), row, "left")
    )
    bucket = (
        F.when(~known, "no_date_to_check")
        .when(F.col("_in"), "in_row")
        .when(F.col("_in").isNotNull(), f"within_{margin}_pages")
        .when(F.col("_any"), "elsewhere_in_doc")
        .when(~F.col("summarized"), "wrong_but_never_shipped")
        .when(F.col("_month"), "day_differs")
        .otherwise("absent")
    )
    return marked.withColumn("bucket", bucket).select(*rows.columns, "bucket")
