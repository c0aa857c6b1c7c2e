"""Queries of listings and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import text as X
from quirewise.operators import listings as L
from quirewise.registry import query
from quirewise.sources.tables import table


@query(
    """SELECT c_custkey, c_name, c_mktsegment, coalesce(n, 0) AS n_rows FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""
)
def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the number of its rows."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    records = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return L.counts_by(records, orders, "c_custkey")


@query(
    """WITH l AS (SELECT c_custkey, c_name, c_mktsegment AS state, coalesce(n, 0) AS n_rows FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
SELECT * FROM l WHERE contains(lower(c_name), '1') AND state IN ('BUILDING', 'MACHINERY') ORDER BY n_rows DESC, c_custkey LIMIT 25 OFFSET 25"""
)
def listing_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a searched, filtered and sorted listing."""
    listed = listing_counts(spark, sf_dir).withColumnRenamed("c_mktsegment", "state")
    found = L.search(listed, "c_name", "1", ["BUILDING", "MACHINERY"])
    return L.page_of(found, [F.col("n_rows").desc(), F.col("c_custkey")], 25, 1)


SUMMARIES = """s AS (SELECT d.doc_id, '[ManualCheck] Report ' || source || ' [Diagnostic Study] x (Pages 1-' || (length(d.text) % 90) || ')' AS title,
  CASE WHEN d.doc_id % 3 = 0 THEN 'Verified ' || lang END AS verified_title, CASE WHEN d.doc_id % 5 = 0 THEN '' END AS edited_title,
  '**DOI**: 01/02/20' || CASE WHEN d.doc_id % 2 = 0 THEN ' & 03/04/21' ELSE '' END || '. ' || replace(d.text, chr(10), ' ') AS text,
  CASE WHEN d.doc_id % 4 = 0 THEN replace(d.text, chr(10), ' ') END AS verified_text,
  CASE WHEN d.doc_id % 7 = 0 THEN '' END AS edited_text, '0' || (1 + d.doc_id % 9) || '/1' || (d.doc_id % 10) || '/2020' AS date,
  CASE WHEN d.doc_id % 6 = 0 THEN '-' END AS edited_date, l.quality = 0 AS excluded FROM documents d LEFT JOIN labels l USING (doc_id))"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries with raw, verified and edited layers."""
    i, flat = F.col("doc_id"), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(
        "doc_id",
        F.concat(F.lit("[ManualCheck] Report "), "source", F.lit(" [Diagnostic Study] x (Pages 1-"), (F.length("text") % 90).cast("string"), F.lit(")")).alias("title"),
        F.when(i % 3 == 0, F.concat(F.lit("Verified "), "lang")).alias("verified_title"),
        F.when(i % 5 == 0, "").alias("edited_title"),
        F.concat(F.lit("**DOI**: 01/02/20"), F.when(i % 2 == 0, " & 03/04/21").otherwise(""), F.lit(". "), flat).alias("text"),
        F.when(i % 4 == 0, flat).alias("verified_text"),
        F.when(i % 7 == 0, "").alias("edited_text"),
        F.concat(F.lit("0"), (1 + i % 9).cast("string"), F.lit("/1"), (i % 10).cast("string"), F.lit("/2020")).alias("date"),
        F.when(i % 6 == 0, "-").alias("edited_date"),
        (F.col("quality") == 0).alias("excluded"),
    )


@query(
    f"""WITH {SUMMARIES} SELECT doc_id, coalesce(edited_title, verified_title, title) AS title, coalesce(edited_text, verified_text, text) AS text,
coalesce(edited_date, date) AS date, edited_title IS NOT NULL OR edited_text IS NOT NULL OR edited_date IS NOT NULL AS edited FROM s"""
)
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effective layer of every summary; an empty edit wins."""
    layers = lambda c: F.coalesce(f"edited_{c}", f"verified_{c}", c).alias(c)
    edited = F.col("edited_title").isNotNull() | F.col("edited_text").isNotNull() | F.col("edited_date").isNotNull()
    return summaries(spark, sf_dir).select(
        "doc_id", layers("title"), layers("text"), F.coalesce("edited_date", "date").alias("date"), edited.alias("edited")
    )


@query(
    f"""WITH {SUMMARIES}, e AS (SELECT doc_id, coalesce(edited_title, verified_title, title) AS t, coalesce(edited_text, verified_text, text) AS b,
  coalesce(edited_date, date) AS date, '**DOI**: 01/02/20' || CASE WHEN doc_id % 2 = 0 THEN ' & 03/04/21' ELSE '' END || '.' AS prefix FROM s WHERE NOT coalesce(excluded, false))
SELECT doc_id, date, trim(regexp_replace(rtrim(regexp_replace(regexp_replace(trim(t), '^\\[ManualCheck\\]\\s*', ''), '(?i)\\(pages\\s+\\d+\\s*[-–]\\s*\\d+\\)\\s*$', '')),
  '\\s*\\[Diagnostic Study\\]\\s*', ' ', 'g')) AS title, CASE WHEN NOT contains(b, '**DOI**') THEN prefix || ' ' || b ELSE b END AS text FROM e"""
)
def export_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported titles and bodies of the summaries that are not excluded."""
    kept = summaries(spark, sf_dir).where("NOT coalesce(excluded, false)")
    return L.export_entries(kept).select("doc_id", "date", "title", "text")


@query(
    f"""WITH {SUMMARIES} SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY coalesce(CAST(try_strptime(coalesce(edited_date, date), '%m/%d/%Y') AS DATE), DATE '0001-01-01'), doc_id) AS line
FROM s JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"""
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each entry in its report: undated first, then by date."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    entries = summaries(spark, sf_dir).select("doc_id", F.coalesce("edited_date", "date").alias("date")).join(langs, "doc_id")
    return L.chronological(entries, "lang", "doc_id").select("doc_id", "lang", "line")


@query(
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) END, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE month(o_orderdate) END,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE day(o_orderdate) END, o_orderkey) AS place FROM orders"""
)
def oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates oldest first, those of unknown date last."""
    date = F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", date.alias("date"))
    return L.oldest_first(rows, "o_custkey", "o_orderkey").select("o_orderkey", "place")


BUCKETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query(
    """WITH d AS (SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'), (5, '6-NONE')) v(place, bucket)),
c AS (SELECT o_orderpriority AS bucket, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT place, bucket, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (bucket)) SELECT place, bucket, n, round(100.0 * n / (SELECT sum(n) FROM f), 1) AS share FROM f"""
)
def bucket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of a fixed order of buckets."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bucket"))
    return L.bucket_report(rows, "bucket", BUCKETS)


@query(
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
CASE WHEN p_size % 10 = 3 THEN '[Diagnostic Study] ' ELSE '' END AS tags, CASE WHEN p_size % 10 = 0 THEN 'Reviewed ' || p_size || ' pages of records.'
ELSE 'Reviewed ' || p_size || ' pages of records from ' || p_brand || '.' END AS intro FROM part"""
)
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File slugs, title tags and opening sentences."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"),
        L.row_tags(F.lit(""), (size % 10).cast("string")).alias("tags"),
        L.intro_sentence(size, F.when(size % 10 == 0, " ").otherwise(F.col("p_brand"))).alias("intro"),
    )


@query(
    """WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(p) = 1 THEN 'page ' || p[1] ELSE 'pages ' || array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] END AS phrase FROM g"""
)
def page_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put into words."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_orderkey").agg(X.page_phrase(F.collect_set("l_linenumber")).alias("phrase"))
