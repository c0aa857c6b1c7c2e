"""Queries on review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import rows as R
from quirewise.registry import query
from quirewise.sources.tables import table

CATEGORIES = ["A", "N"]
#: Line items as review rows of an order: spans of pages, some of them faulty.
ROWS = """rows_v AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS idx,
  CASE WHEN l_partkey % 97 = 0 THEN '3.5' ELSE CAST(l_linenumber * 10 - l_suppkey % 12 AS VARCHAR) END AS start,
  CAST(l_linenumber * 10 - l_suppkey % 12 + CAST(floor(l_quantity) AS BIGINT) % 11 AS VARCHAR) AS "end", l_returnflag AS category FROM lineitem)"""
ERROR = """CASE WHEN s IS NULL OR e IS NULL THEN 'not an integer' WHEN NOT (s >= 1 AND s <= e AND e <= 70) THEN 'out of range'
  WHEN s <= coalesce(prev, 0) THEN 'overlaps the row before' WHEN category NOT IN ('A', 'N') THEN 'unknown category' END"""


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("l_linenumber") * 10 - F.col("l_suppkey") % 12
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber").cast("bigint") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("idx"),
        F.when(F.col("l_partkey") % 97 == 0, "3.5").otherwise(first.cast("bigint").cast("string")).alias("start"),
        (first + F.floor("l_quantity") % 11).cast("bigint").cast("string").alias("end"),
        F.col("l_returnflag").alias("category"),
    )


def _errors(spark: SparkSession, sf_dir: str, running: bool) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    sizes = rows.select("doc_id").distinct().select("doc_id", F.lit(70).alias("n"))
    return R.row_errors(rows, sizes, CATEGORIES, "doc_id", "idx", running)


@query(
    f"""WITH {ROWS}, t AS (SELECT *, TRY_CAST(start AS INT) AS s0, start NOT LIKE '%.%' AS w, TRY_CAST("end" AS INT) AS e FROM rows_v),
p AS (SELECT *, CASE WHEN w THEN s0 END AS s, lag(e) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM t),
x AS (SELECT doc_id, idx, {ERROR} AS error FROM p)
SELECT doc_id, min(idx) AS idx, min_by(error, idx) AS error FROM x WHERE error IS NOT NULL GROUP BY doc_id"""
)
def row_validation_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of every record's rows."""
    return R.first_error(_errors(spark, sf_dir, False), "doc_id", "idx")


@query(
    f"""WITH {ROWS}, t AS (SELECT *, TRY_CAST(start AS INT) AS s0, start NOT LIKE '%.%' AS w, TRY_CAST("end" AS INT) AS e FROM rows_v),
p AS (SELECT *, CASE WHEN w THEN s0 END AS s, max(e) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
x AS (SELECT doc_id, idx, {ERROR} AS error FROM p) SELECT * FROM x WHERE error IS NOT NULL"""
)
def row_validation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faulty rows, against the furthest end so far."""
    return _errors(spark, sf_dir, True)


OLD_NEW = """old AS (SELECT o_custkey AS doc_id, o_orderkey AS start, o_orderkey % 7 AS "end", o_orderpriority AS source_text,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 END AS grp FROM orders WHERE o_orderkey % 5 <> 0),
new AS (SELECT o_custkey AS doc_id, o_orderkey AS start, CASE WHEN o_orderkey % 11 = 0 THEN 8 ELSE o_orderkey % 7 END AS "end", o_orderstatus AS title FROM orders)"""


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    old = orders.where(key % 5 != 0).select(
        F.col("o_custkey").alias("doc_id"), key.alias("start"), (key % 7).alias("end"), F.col("o_orderpriority").alias("source_text"),
        F.when(key % 4 == 0, key % 3).alias("grp"),
    )
    new = orders.select(
        F.col("o_custkey").alias("doc_id"), key.alias("start"), F.when(key % 11 == 0, 8).otherwise(key % 7).alias("end"),
        F.col("o_orderstatus").alias("title"),
    )
    return old, new


@query(
    f"""WITH {OLD_NEW} SELECT n.*, o.source_text, o.grp, o.doc_id IS NULL AS fresh FROM new n
LEFT JOIN old o ON o.doc_id = n.doc_id AND o.start = n.start AND o."end" = n."end\""""
)
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows that keep what was known of an unchanged span."""
    old, new = _old_new(spark, sf_dir)
    known = old.withColumn("fresh", F.lit(False))
    columns = {"source_text": F.lit(None), "grp": F.lit(None), "fresh": F.lit(True)}
    return R.carry_over(new, known, columns, ["doc_id", "start", "end"])


@query(
    f"""WITH {OLD_NEW}, lost AS (SELECT DISTINCT doc_id, grp FROM old o WHERE grp IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id AND n.start = o.start AND n."end" = o."end"))
SELECT o.* FROM old o JOIN lost USING (doc_id, grp)"""
)
def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of groups of which a member's span is gone."""
    old, new = _old_new(spark, sf_dir)
    return R.reopened_groups(new, old, ["doc_id", "start", "end"], "grp").select(*old.columns)


@query(
    """WITH wanted AS (SELECT DISTINCT o_orderkey AS doc_id, CAST(o_orderkey % 6 AS BIGINT) AS part FROM orders WHERE o_orderstatus <> 'P'),
existing AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 6 AS BIGINT) AS part, l_linenumber AS idx FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY idx) AS rn FROM existing)
SELECT doc_id, part, idx, CASE WHEN w.doc_id IS NULL THEN 'stale' WHEN rn = 1 THEN 'keep' ELSE 'repeat' END AS status FROM k
  LEFT JOIN wanted w USING (doc_id, part)
UNION ALL SELECT doc_id, part, NULL, 'pending' FROM wanted WHERE (doc_id, part) NOT IN (SELECT doc_id, part FROM existing)"""
)
def reconcile_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to keep, drop and make, by natural key."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("part")
    )
    existing = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 6).alias("part"), F.col("l_linenumber").alias("idx")
    )
    return R.reconcile(wanted, existing, ["doc_id", "part"], "idx")


PAGE_ATTEMPTS = """att AS (SELECT user_id AS doc_id, CAST(event_id % 20 + 1 AS BIGINT) AS page, event_type <> 'error' AS ok, event_id FROM events)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % 20 + 1).alias("page"), (F.col("event_type") != "error").alias("ok"), "event_id"
    )


@query(
    f"WITH {PAGE_ATTEMPTS} SELECT doc_id, page, ok, event_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ok DESC, event_id) AS rn FROM att) WHERE rn = 1"
)
def upsert_success_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows where a success replaces a failure and nothing replaces a success."""
    return R.upsert_success_wins(_attempts(spark, sf_dir), ["doc_id", "page"], "ok", "event_id")


@query(
    f"""WITH {PAGE_ATTEMPTS}, s AS (SELECT DISTINCT doc_id, unnest(range(1, 21)) AS page FROM att)
SELECT doc_id, page FROM s WHERE (doc_id, page) NOT IN (SELECT doc_id, page FROM att WHERE ok)"""
)
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that still lack a successful row."""
    found = _attempts(spark, sf_dir)
    sizes = found.select("doc_id").distinct().select("doc_id", F.lit(20).alias("n"))
    return R.missing_pages(sizes, found)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user."""
    return R.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    """SELECT c_custkey, CASE WHEN o.o_custkey IS NOT NULL THEN left('edited ' || c_name, 20) ELSE c_name END AS c_name, c_mktsegment FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 = 0) o ON o_custkey = c_custkey"""
)
def patch_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only supplied fields change, cut to their width."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ids = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    changes = ids.join(base, "c_custkey").select(
        "c_custkey", F.concat(F.lit("edited "), "c_name").alias("c_name"), F.lit(True).alias("has_c_name"),
        F.lit(None).cast("string").alias("c_mktsegment"), F.lit(False).alias("has_c_mktsegment"),
    )
    return R.patch(base, changes, ["c_custkey"], {"c_name": 20, "c_mktsegment": 16})


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag AS flag FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'O'"""
)
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a record replaced as a whole."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("new").alias("flag")
    )
    return R.replace_partition(old, new, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without those of deleted parents."""
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.cascade_delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus IN ('O', 'P') THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders"""
)
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state changes only from the states that allow it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    change = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus"))
    return R.compare_and_set(rows, change, "o_orderkey", "o_orderstatus", ["O", "P"])


@query(
    """SELECT e.event_id, coalesce(v.quality, 0) AS verdict FROM events e LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) v ON v.doc_id = e.user_id"""
)
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external call's verdicts, with the call's failure default."""
    known = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("user_id")).agg(F.max("quality").alias("verdict"))
    return R.verdicts(table(spark, sf_dir, "events").select("event_id", "user_id"), known, ["user_id"], "verdict", F.lit(0)).drop("user_id")


@query(
    """WITH a AS (SELECT l_orderkey AS doc_id, list_sort(list(DISTINCT [l_linenumber, l_linenumber + l_partkey % 2])) AS s FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS doc_id, list_sort(list(DISTINCT [l_linenumber, l_linenumber + l_suppkey % 2])) AS s FROM lineitem GROUP BY 1)
SELECT a.doc_id, a.s = b.s AS same FROM a JOIN b USING (doc_id)"""
)
def reviewed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two sides of a record hold the same set of spans."""
    items = table(spark, sf_dir, "lineitem")
    side = lambda c: items.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("start"), (F.col("l_linenumber") + F.col(c) % 2).alias("end")
    )
    return R.same_span_sets(side("l_partkey"), side("l_suppkey"), "doc_id")
