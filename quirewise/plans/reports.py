"""Queries of bundles, checks and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import reports as R
from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .views import GOLD_SPANS, GOLD_STARTS, PAGES, SIZES, gold

ROWS = f"""{PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS}, rw AS (SELECT doc_id, start, "end", CAST(start % 4 AS VARCHAR) AS category, start AS idx FROM gold_spans)"""


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    rows = S.tile(gold(paged), sizes)
    return rows.withColumn("category", (F.col("start") % 4).cast("string")).withColumn("idx", F.col("start")), sizes


@query(
    f"""WITH {ROWS} SELECT r.doc_id, r.start, r."end", coalesce((SELECT string_agg(s.start || '-' || s."end", ',' ORDER BY s.start, s."end") FROM rw s
WHERE s.doc_id = r.doc_id AND s.category = '3' AND NOT (s.start = r.start AND s."end" = r."end")), '') AS studies FROM rw r"""
)
def standalone_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other studies of every row's record."""
    return R.standalone_studies(_rows(spark, sf_dir)[0], "doc_id")


@query(
    f"""WITH {ROWS}, p AS (SELECT doc_id, idx, unnest(range(start, "end" + 1)) AS page FROM rw WHERE category IN ('1', '3'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, page) AS place, page FROM p"""
)
def bundle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of two categories put together."""
    rows, sizes = _rows(spark, sf_dir)
    return R.bundle_pages(rows, sizes, ["1", "3"])


@query(
    """WITH l AS (SELECT o_custkey AS rec, o_orderkey AS line_no, CASE WHEN o_orderkey % 9 = 0 THEN 'short,line' ELSE '1,2,' || o_orderkey % 3 || ',' || CASE WHEN o_orderkey % 7 = 0 THEN '13/45/2020' WHEN o_orderkey % 5 = 0 THEN '-' ELSE strftime(o_orderdate, '%m/01/2020') END END AS line FROM orders),
p AS (SELECT rec, line_no, string_split(line, ',') AS f FROM l), t AS (SELECT *, len(f) >= 4 AS ok, count(*) OVER (PARTITION BY rec, len(f) >= 4, f[3], f[4]) AS times FROM p),
e AS (SELECT rec, line_no, CASE WHEN NOT ok THEN 'columns' WHEN f[4] <> '-' AND try_strptime(f[4], '%m/%d/%Y') IS NULL THEN 'date' WHEN times > 1 AND f[4] <> '-' THEN 'repeated' END AS error FROM t)
SELECT * FROM e WHERE error IS NOT NULL"""
)
def page_map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty lines of page maps."""
    i = F.col("o_orderkey")
    date = F.when(i % 7 == 0, "13/45/2020").when(i % 5 == 0, "-").otherwise(F.date_format("o_orderdate", "MM/'01'/2020"))
    line = F.when(i % 9 == 0, "short,line").otherwise(F.concat(F.lit("1,2,"), (i % 3).cast("string"), F.lit(","), date))
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec"), i.alias("line_no"), line.alias("line"))
    return R.page_map_errors(lines, "rec")


@query("SELECT c_custkey || ',' || c_name || ',' || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_mktsegment END AS line FROM customer")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines."""
    rows = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")))
    return R.csv_lines(rows, ["c_custkey", "c_name", "segment"])


@query(
    """WITH d AS (SELECT o_custkey AS doc_id, o_orderkey AS i, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 2) AS said, o_orderdate + INTERVAL 1 DAY * (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END) AS sent, o_orderdate AS od FROM orders),
h AS (SELECT DISTINCT doc_id, strftime(said, '%m/%d/%Y') AS date FROM d),
r AS (SELECT doc_id, strftime(sent, '%m/%d/%Y') AS date, bool_or(i % 5 > 0) AS shipped FROM d GROUP BY ALL),
t AS (SELECT DISTINCT doc_id, strftime(od, '%m/%d/%Y') AS date FROM d WHERE doc_id % 2 = 0),
b AS (SELECT coalesce(h.doc_id, r.doc_id) AS doc_id, coalesce(h.date, r.date) AS date, h.doc_id IS NOT NULL AS listed, shipped FROM h FULL JOIN r ON h.doc_id = r.doc_id AND h.date = r.date)
SELECT doc_id, date, CASE WHEN listed AND shipped THEN 'delivered' WHEN listed AND shipped IS NOT NULL THEN 'excluded' WHEN listed AND (doc_id, date) IN (SELECT doc_id, date FROM t) THEN 're_dated' WHEN listed THEN 'unfound' ELSE 'extra' END AS bucket
FROM b WHERE listed OR shipped"""
)
def delivered_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that people list against the dates that are delivered."""
    i, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    moved = lambda n: F.date_format(F.date_add(day, n.cast("int")), "MM/dd/yyyy")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), i.alias("i"), moved(i % 2).alias("said"), moved(F.when(i % 3 == 0, 2).otherwise(0)).alias("sent"),
        F.when(F.col("o_custkey") % 2 == 0, F.date_format(day, "MMMM d, yyyy")).alias("spelled"),
    )
    human = orders.select("doc_id", F.col("said").alias("date"))
    rows = orders.select("doc_id", F.col("sent").alias("date"), (F.col("i") % 5 > 0).alias("included"))
    texts = orders.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("spelled")), "; ").alias("text"))
    return R.delivered_buckets(human, rows, texts)


@query(
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') AND user_id % 3 > 0 THEN 'fixed ' || user_id ELSE 'original' END AS text, event_type NOT IN ('error', 'view') AS ok FROM events"""
)
def audit_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit's replies leave standing."""
    kind, user = F.col("event_type"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("original").alias("original"), F.when(user % 3 > 0, F.concat(F.lit("fixed "), user.cast("string"))).otherwise("  ").alias("fixed"),
        F.when(kind == "error", "timeout").alias("error"), (kind == "view").alias("truncated"),
    )
    return R.audited(rows)


@query(
    f"""WITH {ROWS} SELECT doc_id, start, "end", category, 't' AS title, '' AS flag FROM rw UNION ALL
SELECT doc_id, 2, 3 + doc_id % 4, '100', '(added manually)', 'x' FROM sizes WHERE 3 + doc_id % 4 <= n"""
)
def insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual rows added where they fit the record."""
    rows, sizes = _rows(spark, sf_dir)
    wanted = sizes.select("doc_id", F.lit(2).alias("start"), (3 + F.col("doc_id") % 4).cast("int").alias("end"))
    return R.insert_row(rows.withColumn("title", F.lit("t")).withColumn("flag", F.lit("")), wanted, sizes)


@query(f"""WITH {ROWS} SELECT doc_id, start, 7 + start - 1 AS target_page FROM rw""")
def target_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that each title links to."""
    return R.target_pages(_rows(spark, sf_dir)[0], F.lit(7)).select("doc_id", "start", "target_page")


@query()
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in plain ASCII."""
    return R.safe_names(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name")), "name")
