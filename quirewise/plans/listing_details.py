"""Queries of the details of listings, groups, rows and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import dates as D
from quirewise.functions import text as X
from quirewise.operators import dedup as U
from quirewise.operators import evaluate as E
from quirewise.operators import jobs as J
from quirewise.operators import listings as L
from quirewise.operators import rows as W
from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .views import GOLD_STARTS, PAGES, PRED_STARTS, SIZES, gold, predicted


@query(
    """SELECT doc_id, doc_id % 4 = 0 OR doc_id % 6 = 0 OR doc_id % 9 = 0 AS edited, doc_id % 2 = 0 AND n_chars % 3 > 0 AS verify_changed FROM documents"""
)
def edit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which summaries a person edited, and which the audit changed."""
    i, n = F.col("doc_id"), F.col("n_chars")
    mark = lambda k: F.when(i % k == 0, "")
    issues = F.when(n % 3 == 1, F.array(F.lit("a"))).when(n % 3 == 2, F.array(F.lit("b"), F.lit("c")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", mark(4).alias("edited_title"), mark(6).alias("edited_date"), mark(9).alias("edited_text"), (i % 2 == 0).alias("verified"), issues.alias("verify_issues")
    )
    return L.with_edit_marks(rows).select("doc_id", "edited", "verify_changed")


@query(
    """WITH j AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS seq FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1)
SELECT c_custkey, trim(CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END || ' ' || CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE c_name END) AS name, seq, state FROM customer LEFT JOIN j ON o_custkey = c_custkey"""
)
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their names and the newest active job."""
    nation = F.col("c_nationkey")
    docs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(nation % 3 != 0, F.col("c_mktsegment")).alias("first_name"), F.when(nation % 4 != 0, F.col("c_name")).alias("last_name")
    )
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("state"))
    return L.document_listing(docs, jobs, "c_custkey", ("O", "P"), "seq").select("c_custkey", "name", "active_job.seq", "active_job.state")


@query(
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC NULLS LAST, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END ASC NULLS LAST, o_orderkey) AS place FROM orders"""
)
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by two columns, one of them downwards."""
    price = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("price"))
    return L.sort_places(rows, "o_custkey", [("o_orderstatus", False), ("price", True)], "o_orderkey").select("o_orderkey", "place")


@query(
    """SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(source || '/ ' || lang || ' _' || left(coalesce(text, ''), 0) || md5(coalesce(text, '')) || '.', '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'file') AS name FROM documents"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe file names of documents, by source, language and digest."""
    raw = F.concat("source", F.lit("/ "), "lang", F.lit(" _"), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", X.file_name(raw).alias("name"))


@query(
    """SELECT l_orderkey, round(avg(CASE WHEN l_partkey % 4 > 1 THEN l_extendedprice END), 6) AS mean FROM lineitem GROUP BY l_orderkey"""
)
def known_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means that skip what is no number."""
    kind = F.col("l_partkey") % 4
    value = F.when(kind == 0, None).when(kind == 1, float("nan")).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(E.known_mean(value), 6).alias("mean"))


@query(
    """SELECT l_orderkey, arg_min(l_shipdate, l_linenumber * 1000000 + l_partkey) FILTER (WHERE l_partkey % 3 = 0) AS shipped, arg_min(l_returnflag, l_linenumber * 1000000 + l_partkey) FILTER (WHERE l_suppkey % 2 = 0) AS flag FROM lineitem GROUP BY 1"""
)
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known values of each group."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("at"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_shipdate")).alias("shipped"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")).alias("flag"),
    )
    return W.first_known(rows, "l_orderkey", "at", ["shipped", "flag"])


@query(
    """SELECT o_orderkey, o_orderkey % 7 NOT IN (4, 5, 6) AS found FROM orders"""
)
def date_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether dates are written in texts, also with blanks or ordinals."""
    i, od = F.col("o_orderkey") % 7, F.col("o_orderdate")
    day = F.dayofmonth(od)
    ending = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    spelled = F.concat(F.date_format(od, "MMMM"), F.lit(" "), day.cast("string"), ending, F.lit(", "), F.date_format(od, "yyyy"))
    text = (
        F.when(i == 0, F.date_format(od, "M / d / yy")).when(i == 1, F.concat(F.lit("on "), F.date_format(od, "MM dd yyyy")))
        .when(i == 2, spelled).when(i == 3, F.date_format(od, "M.d.yyyy")).when(i == 4, F.date_format(F.date_add(od.cast("date"), 1), "MM/dd/yyyy"))
        .when(i == 5, F.concat(F.lit("9"), F.date_format(od, "MM/dd/yyyy"))).otherwise("no date")
    )
    date = F.date_format(od, "MM/dd/yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.appears_loosely(date, text).alias("found"))


@query(
    """WITH m AS (SELECT o_orderkey AS id, o_custkey AS grp, o_orderstatus = 'O' AS include, CASE o_custkey % 4 WHEN 0 THEN 'keep_one' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'outside' ELSE 'none' END AS action,
min(o_orderkey) OVER (PARTITION BY o_custkey) AS k, bool_or(o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS a FROM orders)
SELECT id, CASE WHEN action = 'keep_one' THEN id = k AND a ELSE include END AS include, action = 'keep_one' AND id = k AS kept, action = 'dismiss' AS dismissed FROM m"""
)
def resolved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of which one member is kept, or that are dismissed."""
    no = F.lit(False)
    members = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), (F.col("o_orderstatus") == "O").alias("include"), no.alias("kept"), no.alias("dismissed")
    )
    kind = F.col("grp") % 4
    first = members.groupBy("grp").agg(F.min("id").alias("kept_key")).where(kind < 3)
    action = F.when(kind == 1, "dismiss").otherwise("keep_one")
    actions = first.select("grp", action.alias("action"), F.when(kind == 2, -1).otherwise(F.col("kept_key")).cast("bigint").alias("kept_key"))
    return U.resolved(members, actions, "grp", "id").select("id", "include", "kept", "dismissed")


@query(
    f"""WITH {PAGES}, {GOLD_STARTS}, {PRED_STARTS} SELECT DISTINCT p.doc_id, p.start FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.start = p.start)
AND EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND abs(g.start - p.start) <= 2)"""
)
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted starts that are off by two pages at most."""
    paged = pages(spark, sf_dir)
    return E.near_misses(predicted(paged), gold(paged))


@query(
    f"""WITH {PAGES}, {SIZES}, {GOLD_STARTS}, m AS (SELECT DISTINCT g.doc_id, least(greatest(start + CASE WHEN g.doc_id % 5 = 4 THEN 0 ELSE g.doc_id % 5 - 2 END, 1), n) AS start, n FROM gold g JOIN sizes USING (doc_id))
SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end" FROM m"""
)
def shifted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans tiled anew after each document's starts are moved by its constant."""
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    shifts = sizes.where("doc_id % 5 <> 4").select("doc_id", (F.col("doc_id") % 5 - 2).alias("shift"))
    return S.tile(E.shifted(gold(paged), shifts, sizes), sizes)


@query(
    """WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS start, o_orderkey + o_orderkey % 3 AS "end" FROM orders), r AS (SELECT o_custkey AS doc_id, o_orderkey AS start, o_orderkey + o_orderkey % 2 AS "end", o_orderstatus AS category FROM orders)
SELECT s.doc_id, s.start, s."end", category AS live FROM s LEFT JOIN r USING (doc_id, start, "end")"""
)
def live_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category that each summary's span has now; none where it moved."""
    key = F.col("o_orderkey")
    side = lambda k, *more: table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("start"), (key + key % k).alias("end"), *more)
    return W.with_live(side(3), side(2, F.col("o_orderstatus").alias("category")), "doc_id")


@query(
    """WITH a AS (SELECT user_id, event_id % 30 AS page, row_number() OVER (PARTITION BY user_id, event_id % 30 ORDER BY event_id) - 1 AS attempt, event_type NOT IN ('error', 'view') AS ok FROM events),
g AS (SELECT user_id, page, min(attempt) FILTER (WHERE ok) AS f, max(attempt) AS l FROM a WHERE attempt <= 1 GROUP BY ALL) SELECT user_id, page, f IS NOT NULL AS ok, coalesce(f, l) + 1 AS tries FROM g"""
)
def retried_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read once more after an error."""
    from pyspark.sql import Window

    page = F.col("event_id") % 30
    attempt = F.row_number().over(Window.partitionBy("user_id", page).orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select("user_id", page.alias("page"), attempt.alias("attempt"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return W.retried(rows, "user_id")


@query(
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'view' THEN 'queued' ELSE 'running' END AS state FROM events),
t AS (SELECT user_id, min(event_id) AS z FROM e WHERE state IN ('done', 'error') GROUP BY 1), l AS (SELECT e.*, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM e LEFT JOIN t USING (user_id) WHERE z IS NULL OR event_id <= z)
SELECT user_id, event_id, state FROM l WHERE w IS NULL OR w <> state"""
)
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted changes of every job's state."""
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "done").when(kind == "error", "error").when(kind == "view", "queued").otherwise("running")
    return J.accepted_states(table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state")), "user_id", "event_id")
