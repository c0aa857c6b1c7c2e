"""The whole segmentation of a record as one plan around tables of external verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.operators import spans as S

#: The category of rows whose categorisation did not come back.
DEFAULT = "100"


def segment(
    windows: DataFrame,
    reports: DataFrame,
    votes: DataFrame,
    continues: DataFrame,
    cap: int = 200,
    merge: bool = True,
    key: str = "doc_id",
) -> DataFrame:
    """``key, start, end, title, category, flag, n_rows``: the rows of every record, in its final spans.

    ``windows`` (``key, k, start, end``) are cut by bytes and pages; what each
    reported (``reports``: ``key, k, pos, start, title``) is merged by ownership
    into spans that tile the record.
    ``votes`` (``key, start, end, category``) names categories: a row without a
    vote gets the default and a flag.  Of the boundaries worth a second look, at
    most ``cap`` a record, those that ``continues`` (``key, start, same``) refutes
    are folded into the row before or, without ``merge``, keep their rows and a
    flag.  A record with a page over the budget has no windows and no rows.
    """
    windows = windows.where("k >= 0")
    sizes = windows.groupBy(key).agg(F.max("end").alias("n"))
    merged = S.ownership_merge(reports, windows, sizes, key)
    voted = merged.join(votes.select(key, "start", "end", F.col("category").alias("_c")), [key, "start", "end"], "left")
    rows = voted.select(
        key, "start", "end", "title",
        F.coalesce("_c", F.lit(DEFAULT)).alias("category"),
        F.when(F.col("_c").isNull(), "x").otherwise(F.col("flag")).alias("flag"),
        F.lit("-").alias("date"),
    )
    asked = S.suspects(rows, cap, key, "start").select(key, "start").join(continues.select(key, "start", "same"), [key, "start"])
    judged = rows.join(asked, [key, "start"], "left").withColumn("same", F.coalesce("same", F.lit(False)))
    if merge:
        folded = S.fold_islands(judged, F.col("same"), key, "start")
        first = rows.select(key, "start", "category")
        final = folded.join(first, [key, "start"]).select(key, "start", "end", "title", "category", "flag", "n_rows")
    else:
        marked = F.when(F.col("same"), "x").otherwise(F.col("flag"))
        final = judged.select(key, "start", "end", "title", "category", marked.alias("flag"), F.lit(1).cast("bigint").alias("n_rows"))
    return final


def with_injuries(rows: DataFrame, injuries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segmented rows with ``injury_date``, read last, from the final spans; none is ``-``."""
    dated = rows.join(injuries.select(key, "start", "end", "injury_date"), [key, "start", "end"], "left")
    return dated.withColumn("injury_date", F.coalesce("injury_date", F.lit("-"))).select(
        key, "start", "end", "title", "category", "flag", "injury_date", "n_rows"
    )
