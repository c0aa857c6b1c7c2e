"""Views that stand in for the records' own tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.sources.tables import table

PAGES = """pages_v AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page, unnest(l) AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
SIZES = "sizes AS (SELECT doc_id, max(page) AS n FROM pages_v GROUP BY doc_id)"
GOLD_STARTS = "gold AS (SELECT doc_id, page AS start FROM pages_v WHERE page = 1 OR length(text) % 5 = 0)"
PRED_STARTS = (
    "pred AS (SELECT doc_id, page AS start FROM pages_v WHERE length(text) % 5 = 0 AND length(text) % 4 <> 0 OR length(text) % 13 = 0)"
)
GOLD_SPANS = """gold_spans AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end"
  FROM gold JOIN sizes USING (doc_id))"""
PRED_SPANS = """pred_all AS (SELECT doc_id, start FROM pred UNION SELECT doc_id, 1 FROM sizes),
pred_spans AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end"
  FROM pred_all JOIN sizes USING (doc_id))"""
TURNS = """turns_v AS (SELECT conv_id, turn, role, text, role AS category, 'turn ' || turn AS title,
  CASE WHEN length(text) % 6 = 0 THEN '-' ELSE 'd' || length(text) % 3 END AS date, CASE WHEN length(text) % 9 = 0 THEN 'x' ELSE '' END AS flag,
  turn * 10 + 1 AS start, turn * 10 + 1 + length(text) % 8 AS "end" FROM conversations)"""


def gold(paged: DataFrame) -> DataFrame:
    """``doc_id, start``: the true starts of spans, by a rule on the pages' lengths."""
    return paged.where((F.col("page") == 1) | (F.length("text") % 5 == 0)).select("doc_id", F.col("page").alias("start"))


def predicted(paged: DataFrame) -> DataFrame:
    """``doc_id, start``: starts that differ from the true ones here and there."""
    n = F.length("text")
    return paged.where(((n % 5 == 0) & (n % 4 != 0)) | (n % 13 == 0)).select("doc_id", F.col("page").alias("start"))


def predicted_all(paged: DataFrame) -> DataFrame:
    """The predicted starts, with each record's first page."""
    return predicted(paged).union(paged.where("page = 1").select("doc_id", "page")).distinct()


def turn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as rows of a record, in order."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.col("role").alias("category"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
        F.when(n % 6 == 0, "-").otherwise(F.concat(F.lit("d"), (n % 3).cast("string"))).alias("date"),
        F.when(n % 9 == 0, "x").otherwise("").alias("flag"),
        (F.col("turn") * 10 + 1).cast("int").alias("start"),
        (F.col("turn") * 10 + 1 + n % 8).cast("int").alias("end"),
    )
