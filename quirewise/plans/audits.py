"""Queries of audits, contracts, store copies and written reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.operators import audits as A
from quirewise.operators import contracts as C
from quirewise.operators import jobs as J
from quirewise.operators import reports as R
from quirewise.operators import store as M
from quirewise.registry import query
from quirewise.session import scratch
from quirewise.sources.tables import table

from .jobs import OUTCOME, _outcome

#: A customer's orders as the pages of a record, each with its date in one of the forms that scans give.
_PAGES = """pg AS (SELECT o_custkey AS doc_id, row_number() OVER w AS page, o_orderkey, o_orderdate AS od, lead(o_orderdate, CAST(o_orderkey % 4 AS INT)) OVER w AS ahead,
CASE o_orderkey % 5 WHEN 0 THEN 'seen on ' || strftime(o_orderdate, '%m/%d/%Y') || '.' WHEN 1 THEN 'fax ' || strftime(o_orderdate, '%-m-%-d-%y') WHEN 2 THEN strftime(o_orderdate, '%-m . %d . %Y') || ' visit'
WHEN 3 THEN 'On ' || strftime(o_orderdate, '%B %-d, %Y') || ' again' ELSE 'no date, ref 12/345/6' END AS text FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
rw AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE strftime(coalesce(ahead, od + INTERVAL 1 DAY), '%m/%d/%Y') END AS date, o_orderkey % 7 <> 0 AS summarized FROM pg)"""


@query(
    f"""WITH {_PAGES}, a AS (SELECT o_orderkey, doc_id, page, date, summarized, CAST(substr(date, 1, 2) AS INT) AS m, CAST(substr(date, 4, 2) AS INT) AS d, substr(date, 7) AS y FROM rw WHERE date <> '-'),
pt AS (SELECT *, '(^|[^0-9])0?' || m || '\\s?[/.-]\\s?0?' || d || '\\s?[/.-]\\s?(' || y || '|' || substr(y, 3) || ')([^0-9]|$)' AS loose,
'(?i)' || strftime(make_date(2000, m, 1), '%B') || '\\s+0?' || d || ',?\\s+' || y AS spelled, '(^|[^0-9])0?' || m || '\\s?[/.-]\\s?[0-9]{{1,2}}\\s?[/.-]\\s?(' || y || '|' || substr(y, 3) || ')([^0-9]|$)' AS month FROM a),
f AS (SELECT pt.o_orderkey, any_value(pt.summarized) AS summarized, bool_or(hit AND hp = pt.page) AS own, bool_or(hit AND abs(hp - pt.page) <= 2) AS near, bool_or(hit) AS anywhere, bool_or(other AND hp = pt.page) AS month
FROM pt JOIN LATERAL (SELECT p.page AS hp, regexp_matches(p.text, pt.loose) OR regexp_matches(p.text, pt.spelled) AS hit, regexp_matches(p.text, pt.month) AS other FROM pg p WHERE p.doc_id = pt.doc_id) h ON true GROUP BY pt.o_orderkey)
SELECT o_orderkey, CASE WHEN f.own IS NULL THEN 'no_date_to_check' WHEN own THEN 'in_row' WHEN near THEN 'within_2_pages' WHEN anywhere THEN 'elsewhere_in_doc'
WHEN NOT f.summarized THEN 'wrong_but_never_shipped' WHEN month THEN 'day_differs' ELSE 'absent' END AS bucket FROM rw LEFT JOIN f USING (o_orderkey)"""
)
def date_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row's date stands on the pages of its record."""
    by_page = Window.partitionBy("doc_id").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.to_date("o_orderdate").alias("od"))
    od, kind = F.col("od"), F.col("o_orderkey") % 5
    written = (
        F.when(kind == 0, F.concat(F.lit("seen on "), F.date_format(od, "MM/dd/yyyy"), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("fax "), F.date_format(od, "M-d-yy")))
        .when(kind == 2, F.concat(F.date_format(od, "M . dd . yyyy"), F.lit(" visit")))
        .when(kind == 3, F.concat(F.lit("On "), F.date_format(od, "MMMM d, yyyy"), F.lit(" again")))
        .otherwise("no date, ref 12/345/6")
    )
    paged = orders.withColumns({"page": F.row_number().over(by_page), "text": written})
    # Each row takes the date of an order up to three pages on, or where there is none, a day that no page names.
    ahead = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, F.lead("od", i).over(by_page) if i else od) for i in range(4)], F.date_add(od, 1))
    date = F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise(F.date_format("ahead", "MM/dd/yyyy"))
    rows = paged.withColumn("ahead", ahead).select(
        "doc_id", "o_orderkey", F.col("page").alias("start"), F.col("page").alias("end"), date.alias("date"), (F.col("o_orderkey") % 7 != 0).alias("summarized")
    )
    return A.date_in_source(rows, paged).select("o_orderkey", "bucket")


@query(
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS name, 0 AS place, (SELECT count(*) FROM c) AS copied, CAST(0 AS BIGINT) AS orphans, (SELECT max(c_custkey) + 1 FROM c) AS next_number
UNION ALL SELECT 'orders', 1, (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o), (SELECT max(o_orderkey) + 1 FROM o)
UNION ALL SELECT 'lineitem', 2, (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l), NULL"""
)
def store_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store copied in the order of its references, which are found in its tables; some customers are missing."""
    old = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")}
    old["customer"] = old["customer"].where("c_custkey % 17 <> 0")
    wanted = {"lineitem": ["l_orderkey", "l_linenumber", "l_note"], "orders": ["o_orderkey", "o_custkey", "o_state"], "access_token": ["id"], "customer": ["c_custkey", "c_name"]}
    copied = M.copy_store(old, {"customer": "c_custkey", "orders": "o_orderkey"}, wanted)
    rows = [(x.name, x.place, x.copied, x.orphans, x.next_number) for x in copied]
    return spark.createDataFrame(rows, "name string, place int, copied long, orphans long, next_number long")


@query(
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 17 <> 0)"""
)
def copied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last table of a copied store: those whose parents, and theirs, were copied."""
    old = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")}
    old["customer"] = old["customer"].where("c_custkey % 17 <> 0")
    wanted = {"lineitem": ["l_orderkey", "l_linenumber", "l_note"], "orders": ["o_orderkey"], "customer": ["c_custkey"]}
    return M.copy_store(old, {"customer": "c_custkey", "orders": "o_orderkey"}, wanted)[-1].rows


_REPLIES = """rp AS (SELECT event_id, event_id % 6 + 1 AS n, CASE WHEN event_id % 13 = 0 THEN '{"i": ' WHEN event_id % 17 = 0 THEN '[1]'
ELSE '{"i": ' || CASE WHEN event_id % 5 = 0 THEN '"' || event_id % 9 || '"' ELSE CAST(event_id % 9 AS VARCHAR) END || CASE WHEN event_id % 7 = 0 THEN '' ELSE ', "kind": "' || event_type || '"' END
|| CASE WHEN event_id % 4 = 0 THEN ', "note": ' || CASE WHEN event_id % 8 = 0 THEN 'null' ELSE 'true' END ELSE '' END || '}' END AS reply FROM events)"""


@query(
    f"""WITH {_REPLIES}, j AS (SELECT *, event_id % 13 <> 0 AS ok, event_id % 13 <> 0 AND event_id % 17 <> 0 AS obj FROM rp)
SELECT event_id, NULL::INTEGER AS at, NULL AS field, 'not json' AS problem, reply AS found FROM j WHERE NOT ok
UNION ALL SELECT event_id, NULL, NULL, 'not an object', reply FROM j WHERE ok AND NOT obj
UNION ALL SELECT event_id, 0, 'i', CASE WHEN json_type(reply, '$.i') = 'VARCHAR' THEN 'wrong type' ELSE 'out of range' END, reply ->> '$.i' FROM j
WHERE obj AND (json_type(reply, '$.i') = 'VARCHAR' OR CAST(reply ->> '$.i' AS INT) NOT BETWEEN 1 AND n)
UNION ALL SELECT event_id, 0, 'kind', CASE WHEN json_type(reply, '$.kind') IS NULL THEN 'missing' ELSE 'not among the values' END, reply ->> '$.kind' FROM j
WHERE obj AND (json_type(reply, '$.kind') IS NULL OR (reply ->> '$.kind') NOT IN ('view', 'click', 'purchase'))
UNION ALL SELECT event_id, 0, 'note', 'wrong type', 'true' FROM j WHERE obj AND event_id % 4 = 0 AND event_id % 8 <> 0"""
)
def reply_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the shape that replies were asked for: an index of a row's items, a kind of a list, an optional note."""
    i, text = F.col("event_id"), lambda c: c.cast("string")
    index = F.when(i % 5 == 0, F.concat(F.lit('"'), text(i % 9), F.lit('"'))).otherwise(text(i % 9))
    kind = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(', "kind": "'), "event_type", F.lit('"')))
    note = F.when(i % 8 == 0, ', "note": null').when(i % 4 == 0, ', "note": true').otherwise("")
    reply = F.when(i % 13 == 0, '{"i": ').when(i % 17 == 0, "[1]").otherwise(F.concat(F.lit('{"i": '), index, kind, note, F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", (i % 6 + 1).alias("n"), reply.alias("reply"))
    fields = [C.Field("i", "integer", low=1, high="n"), C.Field("kind", "string", among=("view", "click", "purchase")), C.Field("note", "string", required=False)]
    return C.violations(rows, "reply", fields).drop("n")


@query(
    """SELECT event_id, 0 AS at, 'k' AS field, CASE WHEN json_type(props, '$.k') IS NULL THEN 'missing' ELSE 'out of range' END AS problem, props ->> '$.k' AS found FROM events
WHERE json_valid(props) AND (json_type(props, '$.k') IS NULL OR CAST(props ->> '$.k' AS BIGINT) NOT BETWEEN 10 AND 80)"""
)
def props_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties do not have a number of the expected range."""
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return C.violations(rows, "props", [C.Field("k", "integer", low=10, high=80)])


@query(
    """WITH h AS (SELECT c_custkey, c_name, c_mktsegment, 'Reviewed ' || count(o_orderkey) || ' pages of records.' AS intro FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
l AS (SELECT c_custkey, 0 AS part, NULL::DATE AS day, unnest(range(6)) AS n, unnest(['RE: ' || c_name, 'born -', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END, 'Medical Record Review', intro, 'The following is a summary of those records:']) AS line FROM h
UNION ALL SELECT o_custkey, 1, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '-' ELSE strftime(o_orderdate, '%m/%d/%Y') END || chr(9) || o_orderpriority || ': total ' || o_orderstatus || ' of day' FROM orders
UNION ALL SELECT c_custkey, 2, NULL, 0, 'This concludes the review of submitted records.' FROM h)
SELECT CAST(c_custkey AS VARCHAR) AS record, CAST(1 AS BIGINT) AS n_files, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY part, day NULLS FIRST, n) AS INTEGER) AS n, line FROM l"""
)
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's chronological report, written as one file each and read back."""
    orders = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    date = F.when(i % 6 == 0, "-").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    entries = orders.select(
        F.col("o_custkey").alias("c_custkey"), i.alias("n"), date.alias("date"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("total "), "o_orderstatus", F.lit("\nof day")).alias("text"),
    )
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    kind = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    intro = F.concat(F.lit("Reviewed "), F.col("k").cast("string"), F.lit(" pages of records."))
    # Customers grow with the orders: neither side is gathered in the driver to be broadcast.
    heads = table(spark, sf_dir, "customer").join(counts.hint("merge"), "c_custkey").select("c_custkey", F.col("c_name").alias("name"), F.lit("born -").alias("born"), kind.alias("kind"), intro.alias("intro"))
    path = scratch(spark)
    R.write_reports(R.report_lines(heads, entries, "c_custkey", "n"), "c_custkey", path)
    return R.read_reports(spark, path).select("record", "n_files", "n", "line")


@query(
    f"""WITH e AS (SELECT 'm' || user_id % 7 AS model, {OUTCOME} AS o, CAST(floor(abs(value) * 10) AS BIGINT) AS wait_ms, epoch(ts) AS t FROM events), w AS (SELECT (max(t) - min(t)) / 60.0 AS minutes FROM e)
SELECT model, count(*) FILTER (WHERE o <> 'exhausted') AS attempts, count(*) FILTER (WHERE o = 'accepted') AS accepted, count(*) FILTER (WHERE o = 'rate_limited') AS rejected,
round(coalesce(100.0 * count(*) FILTER (WHERE o = 'rate_limited') / nullif(count(*) FILTER (WHERE o <> 'exhausted'), 0), 0), 6) AS reject_percent, sum(wait_ms) / 1000.0 AS wait_s,
round(count(*) FILTER (WHERE o = 'accepted') / any_value(minutes), 6) AS accepted_a_minute FROM e, w GROUP BY ROLLUP (model)"""
)
def attempt_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, rejections, waits and accepted calls a minute by model, and in all."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), _outcome().alias("outcome"),
        F.floor(F.abs("value") * 10).cast("bigint").alias("wait_ms"), seconds.alias("t"),
    )
    found = J.attempt_statistics(rows, "model", "outcome")
    return found.withColumns({"reject_percent": F.round("reject_percent", 6), "accepted_a_minute": F.round("accepted_a_minute", 6)})
