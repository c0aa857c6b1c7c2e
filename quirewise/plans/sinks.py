"""Queries through files: what is written to the shared folder is read back by the engine's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import rows as W
from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.session import scratch
from quirewise.sources import tables as T
from quirewise.sources.tables import pages, table

from .views import GOLD_SPANS, GOLD_STARTS, PAGES, SIZES, gold


@query(
    """SELECT lang, CAST(sum(1 + length(t) - length(replace(replace(t, chr(10), ''), chr(12), ''))) AS BIGINT) AS n_pages FROM (SELECT lang, coalesce(text, '') AS t FROM documents) GROUP BY lang"""
)
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the text files of each language: every line of every document is a page, a form feed behind each."""
    path = scratch(spark)
    lines = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\f")), F.lit("\f"))
    table(spark, sf_dir, "documents").select("lang", lines.alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 500).text(path)
    files = T.page_count(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    lang = F.url_decode(F.regexp_extract("path", "lang=([^/]*)/", 1))
    named = F.when(lang != "__HIVE_DEFAULT_PARTITION__", lang)
    return files.groupBy(named.alias("lang")).agg(F.sum("n_pages").alias("n_pages"))


@query(
    f"""WITH {PAGES}, k AS (SELECT doc_id, page, text FROM pages_v WHERE page % 3 <> 2), n AS (SELECT doc_id, max(page) AS n FROM k GROUP BY doc_id)
SELECT doc_id, page, CASE WHEN page % 3 <> 2 THEN coalesce(text, '') ELSE '' END AS text FROM pages_v JOIN n USING (doc_id) WHERE page <= n"""
)
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pages of every document from a cache that misses some."""
    path = scratch(spark)
    T.append_log(pages(spark, sf_dir).where("page % 3 <> 2"), path)
    return T.read_ocr_cache(spark, path, "doc_id")


@query(f"WITH {PAGES} SELECT DISTINCT doc_id, page FROM pages_v WHERE page % 2 = 0")
def pages_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a log which was written twice already has."""
    path = scratch(spark)
    T.append_log(pages(spark, sf_dir).where("page % 2 = 0").select("doc_id", "page", "text"), path)
    T.append_log(pages(spark, sf_dir).where("page % 4 = 0").select("doc_id", "page", "text"), path)
    return T.done_pages(spark, path, "doc_id")


@query(f"WITH {PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS} SELECT * FROM gold_spans")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as labels and read back."""
    paged = pages(spark, sf_dir)
    path = scratch(spark)
    T.write_labels(S.tile(gold(paged), S.sizes_of(paged)), path)
    return T.read_labels(spark, path, key="doc_id")


@query(
    """SELECT CAST(o_orderkey AS INT) AS start, CAST(o_orderkey + 3 AS INT) AS "end", o_orderstatus AS category, o_orderpriority AS title, strftime(o_orderdate, '%m/%d/%Y') AS date, '-' AS injury_date FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0"""
)
def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page map read back; lines of other widths and without numbers are skipped."""
    path, i = scratch(spark), F.col("o_orderkey")
    first = F.when(i % 7 == 0, "x").otherwise(i.cast("string"))
    line = F.concat_ws(",", first, (i + 3).cast("string"), "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "MM/dd/yyyy"), F.when(i % 5 == 0, "-,more").otherwise("-"))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return T.read_page_map(spark, path)


@query(
    """SELECT conv_id, turn, 0 AS "at", CAST(turn AS INT) AS start, CAST(turn + 2 AS INT) AS "end", CASE WHEN turn % 2 = 0 THEN role ELSE '-' END AS title, 'd' AS date, '-' AS injury_date FROM conversations WHERE turn % 5 <> 0
UNION ALL SELECT conv_id, turn, 1, CAST(turn + 3 AS INT), CAST(turn + 4 AS INT), role, '-', 'i' FROM conversations"""
)
def reply_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of replies in JSON, some elements broken."""
    turn, text = F.col("turn"), lambda c: c.cast("string")
    start = F.when(turn % 5 == 0, F.lit('"?"')).otherwise(text(turn))
    title = F.when(turn % 2 == 0, F.concat(F.lit(',"t":"'), "role", F.lit('"'))).otherwise("")
    one = F.concat(F.lit('{"s":'), start, F.lit(',"e":'), text(turn + 2), title, F.lit(',"d":"d"}'))
    two = F.concat(F.lit('{"s":"'), text(turn + 3), F.lit('","e":'), text(turn + 4), F.lit(',"title":"'), "role", F.lit('","m":"i"}'))
    reply = F.concat(F.lit("```json\n["), one, F.lit(","), two, F.lit("]\n```"))
    return T.parse_segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply")))


@query("""SELECT DISTINCT o_custkey AS doc_id, strftime(o_orderdate, '%m/%d/%Y') AS date FROM orders WHERE o_orderkey % 3 <> 0""")
def human_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the lines that lead with one."""
    date = F.date_format("o_orderdate", "M/d/yyyy")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on "), date)).otherwise(F.concat(date, F.lit("\t"), "o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), line.alias("text"))
    return T.human_entry_dates(rows)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def common_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that an old store and a new one share."""
    old = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment_old")
    return T.copy_common_columns(old, ["c_custkey", "c_name", "c_segment", "c_acctbal"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS verdict FROM orders""")
def memoised_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known verdicts of a log, and the keys that it does not have yet."""
    orders, path = table(spark, sf_dir, "orders"), scratch(spark)
    T.append_log(orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.col("o_orderstatus").alias("verdict")), path)
    cache = spark.read.schema("o_orderkey long, verdict string").json(path)
    hits, misses = W.memoise(orders.select("o_orderkey"), cache, ["o_orderkey"])
    return hits.unionByName(misses.withColumn("verdict", F.lit(None).cast("string")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board of results where a new result replaces the old one of its key."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return W.upsert(old, orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("state")), ["o_orderkey"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE (SELECT count(*) FROM customer) = 0")
def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are; the seeds only where there are none."""
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return W.seed_if_empty(have, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(
    """SELECT user_id, event_type AS action, event_id AS doc, 'value ' || CAST(floor(value) AS INT) AS detail FROM events"""
)
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audit entries, appended to one log in two batches."""
    path = scratch(spark)
    detail = F.concat(F.lit("value "), F.floor("value").cast("int").cast("string"))
    entries = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("action"), F.col("event_id").alias("doc"), detail.alias("detail"))
    late = F.coalesce(F.col("action").isin("purchase", "signup"), F.lit(False))
    for batch in (~late, late):
        T.append_log(entries.where(batch), path)
    return spark.read.schema("user_id long, action string, doc long, detail string").json(path)
