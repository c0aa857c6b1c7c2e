"""Queries of text and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import dates as D
from quirewise.functions import text as X
from quirewise.operators.caps import repair_caps
from quirewise.registry import query
from quirewise.sources.tables import table

#: Documents with a date of an order written into them.
DATED = """dd AS (SELECT d.doc_id, o_orderdate AS od, strftime(o_orderdate, '%m/%d/%Y') AS assigned,
  d.text || chr(10) || CASE d.doc_id % 6 WHEN 0 THEN ' Date of Exam: ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' '
  WHEN 1 THEN ' Signed on ' || strftime(o_orderdate, '%m-%d-%Y') || ' ' WHEN 2 THEN ' printed on | ' || strftime(o_orderdate, '%m.%d.%Y') || ' '
  WHEN 3 THEN ' DOI ' || strftime(o_orderdate, '%m/%d/%Y') || ' ' WHEN 4 THEN ' on ' || strftime(o_orderdate, '%B %-d, %Y') || ' ' ELSE ' ' END AS text
  FROM documents d JOIN orders ON o_orderkey = d.doc_id)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    od, i = F.col("o_orderdate"), F.col("doc_id") % 6
    written = (
        F.when(i == 0, F.concat(F.lit(" Date of Exam: "), F.date_format(od, "M/d/yyyy"), F.lit(" ")))
        .when(i == 1, F.concat(F.lit(" Signed on "), F.date_format(od, "MM-dd-yyyy"), F.lit(" ")))
        .when(i == 2, F.concat(F.lit(" printed on | "), F.date_format(od, "MM.dd.yyyy"), F.lit(" ")))
        .when(i == 3, F.concat(F.lit(" DOI "), F.date_format(od, "MM/dd/yyyy"), F.lit(" ")))
        .when(i == 4, F.concat(F.lit(" on "), F.date_format(od, "MMMM d, yyyy"), F.lit(" ")))
        .otherwise(" ")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(orders, "doc_id").select(
        "doc_id", F.date_format(od, "MM/dd/yyyy").alias("assigned"), F.concat("text", F.lit("\n"), written).alias("text")
    )


@query(f"WITH {DATED} SELECT doc_id, regexp_replace(text, '\\b\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}}\\b', 'DATEMASK', 'g') AS masked FROM dd")
def date_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their dates masked."""
    return dated(spark, sf_dir).select("doc_id", X.mask_dates(F.col("text")).alias("masked"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '\\b\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{2,4}\\b', 'DATEMASK', 'g')), '[a-z0-9]{2,}')) AS s FROM documents)
SELECT doc_id, len(s) AS n_words, md5(array_to_string(list_sort(s), ' ')) AS digest FROM w"""
)
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word signature of every document."""
    words = X.signature(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ").cast("binary")).alias("digest")
    )


@query(
    """SELECT doc_id, substr(sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '') || chr(0)), 1, 12) AS fingerprint,
substr(sha256(lang || chr(0)), 1, 12) AS short FROM documents"""
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance fingerprints."""
    parts = [F.col(c) for c in ("lang", "source", "text")]
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.fingerprint(*parts).alias("fingerprint"), X.fingerprint(F.col("lang")).alias("short")
    )


@query(
    """WITH r AS (SELECT source, doc_id // 1000 AS part, sha256(string_agg(lang || ':' || doc_id, ',' ORDER BY lang || ':' || doc_id)) AS d FROM documents GROUP BY ALL)
SELECT source, substr(sha256(string_agg(d, ',' ORDER BY part)), 1, 12) AS fingerprint FROM r GROUP BY source"""
)
def group_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint over the digests of each group's ranges, each over its sorted parts: no group is one array."""
    part = F.concat_ws(":", "lang", F.col("doc_id").cast("string"))
    ranged = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part"))
    digests = ranged.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(part)), ","), 256).alias("d"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])
    return digests.groupBy("source").agg(F.substring(F.sha2(F.array_join(ordered, ","), 256), 1, 12).alias("fingerprint"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%y') WHEN 1 THEN 'CT ' || strftime(o_orderdate, '%m/%d/%y') || '-' || strftime(o_orderdate + INTERVAL 40 DAY, '%m/%d/%y')
WHEN 2 THEN strftime(o_orderdate, '%m/%d/%y') || ' & ' || strftime(o_orderdate + INTERVAL 9 DAY, '%m/%d/%y') ELSE '-' END AS injury FROM orders"""
)
def injury_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about injury dates brought into house format."""
    od = F.col("o_orderdate")
    day = lambda x, f="M/d/yyyy": F.date_format(x, f)
    later = lambda n: F.date_add(od.cast("date"), n)
    reply = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Injured on "), day(od), F.lit(", again "), day(od, "MM.dd.yyyy")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("c.t.: "), day(od), F.lit(" through "), day(later(40), "MM/dd/yy")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(day(od, "MM-dd-yyyy"), F.lit(", "), day(later(9), "M.d.yy")))
        .otherwise("not stated")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", X.injury_dates(reply).alias("injury"))


@query(
    """WITH b AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '**DOI**: ' || strftime(o_orderdate, '%m/%d/%y') || '. ' WHEN 1 THEN '**DOI**: ' || strftime(o_orderdate, '%m/%d/%y') || ', 02/03/19, ' ELSE '' END AS p,
  o_orderpriority || ' body' AS rest FROM orders)
SELECT o_orderkey, rtrim(p) AS prefix, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '**DOI**: 05/06/21. ' END || rest AS rewritten FROM b"""
)
def injury_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored injury prefix of a body, and the body rewritten."""
    day, i = F.date_format("o_orderdate", "MM/dd/yy"), F.col("o_orderkey")
    lead = (
        F.when(i % 3 == 0, F.concat(F.lit("**DOI**: "), day, F.lit(". ")))
        .when(i % 3 == 1, F.concat(F.lit("**DOI**: "), day, F.lit(", 02/03/19, ")))
        .otherwise("")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(lead, "o_orderpriority", F.lit(" body")).alias("body"))
    injury = F.when(i % 5 == 0, "-").otherwise("05/06/21")
    return rows.select("o_orderkey", X.injury_prefix(F.col("body")).alias("prefix"), X.with_injury_prefix(F.col("body"), injury).alias("rewritten"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 + 1 BETWEEN 1 AND 12 AND o_orderkey % 40 BETWEEN 1 AND 31 THEN printf('%02d/%02d/%04d', o_orderkey % 7 + 1, o_orderkey % 40,
CASE WHEN o_orderkey % 3 = 0 THEN 2000 + o_orderkey % 100 ELSE 1990 + o_orderkey % 50 END) END AS normal,
try_strptime((o_orderkey % 14) || '/' || (o_orderkey % 33) || '/2024', '%m/%d/%Y') IS NOT NULL OR o_orderkey % 10 = 0 AS valid FROM orders"""
)
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date pieces normalised without a calendar check; date texts validated with one."""
    i = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    year = F.when(i % 3 == 0, i % 100).otherwise(1990 + i % 50)
    date = F.when(i % 10 == 0, "-").otherwise(F.concat(text(i % 14), F.lit("/"), text(i % 33), F.lit("/2024")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.normalise(text(i % 7 + 1), text(i % 40), text(year)).alias("normal"), D.is_valid(date).alias("valid")
    )


@query(
    f"""WITH {DATED} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'took_the_labelled_encounter_date' WHEN 1 THEN 'took_the_signature_date' WHEN 2 THEN 'took_a_print_or_fax_date'
WHEN 3 THEN 'took_the_date_of_injury' ELSE 'no_labels_on_these_pages' END AS bucket FROM dd"""
)
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labelled date a row's date agrees with, best first."""
    text, date = F.col("text"), F.col("assigned")
    found = {f: D.labelled_dates(text, f) for f in D.DATE_LABELS}
    rows = dated(spark, sf_dir).select("doc_id", "assigned", *[v.alias(k) for k, v in found.items()])
    took = dict(
        zip(
            D.DATE_LABELS,
            ("took_the_labelled_encounter_date", "took_the_signature_date", "took_a_print_or_fax_date", "took_the_date_of_injury"),
            strict=True,
        )
    )
    bucket = F.when(date.isNull() | date.isin("", "-"), "no_date_to_check").when(
        F.size(F.concat(*found)) == 0, "no_labels_on_these_pages"
    )
    for family, name in took.items():
        bucket = bucket.when(F.array_contains(F.col(family), date), name)
    return rows.select("doc_id", bucket.otherwise("date_not_next_to_any_label").alias("bucket"))


@query(
    f"""WITH {DATED} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no_date_to_check' WHEN doc_id % 6 <> 5 AND doc_id % 4 = 0 THEN 'in_row' WHEN doc_id % 6 <> 5 AND doc_id % 4 = 1 THEN 'within_2_pages'
WHEN doc_id % 6 <> 5 AND doc_id % 4 = 2 THEN 'elsewhere_in_doc' WHEN doc_id % 5 = 0 THEN 'wrong_but_never_shipped' ELSE 'absent' END AS bucket FROM dd"""
)
def date_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a row's date is written: in the row, near it, elsewhere, or nowhere."""
    i = F.col("doc_id")
    date = F.when(i % 11 == 0, "-").otherwise(F.col("assigned"))
    here = lambda *k: F.when((i % 4).isin(*k), F.col("text")).otherwise("")
    rows = dated(spark, sf_dir).select(
        "doc_id", date.alias("date"), here(0).alias("row"), here(0, 1).alias("near"), here(0, 1, 2).alias("all"), (i % 5 != 0).alias("summarized")
    )
    d = F.when(D.is_checkable(F.col("date")), F.col("date"))
    found = lambda c: D.appears(d, F.col(c))
    bucket = (
        F.when(d.isNull(), "no_date_to_check")
        .when(found("row"), "in_row")
        .when(found("near"), "within_2_pages")
        .when(found("all"), "elsewhere_in_doc")
        .when(~F.col("summarized"), "wrong_but_never_shipped")
        .when(F.coalesce(F.rlike(F.col("row"), D.month_pattern(d)), F.lit(False)), "day_differs")
        .otherwise("absent")
    )
    return rows.select("doc_id", bucket.alias("bucket"))


@query()
def caps_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their runs of capitals repaired."""
    return repair_caps(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(
    """SELECT doc_id, len(regexp_extract_all(t, '\\*\\*(.+?)\\*\\*')) AS bold, greatest(1, length(t) // 4 + 258) AS tokens,
regexp_replace(t, '\\*\\*(.+?)\\*\\*', '<b>\\1</b>', 'g') AS html FROM (SELECT doc_id, '**' || source || '** ' || replace(replace(text, '*', ''), '_', '') || ' **' || lang || '**' AS t FROM documents)"""
)
def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold spans counted and rendered, and a token estimate."""
    plain = F.replace(F.replace(F.col("text"), F.lit("*"), F.lit("")), F.lit("_"), F.lit(""))
    t = F.concat(F.lit("**"), "source", F.lit("** "), plain, F.lit(" **"), "lang", F.lit("**"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select(
        "doc_id", X.bold_spans(F.col("t")).alias("bold"), X.token_estimate(F.length("t"), 1).alias("tokens"), X.to_html(F.col("t")).alias("html")
    )


@query(
    """WITH s AS (SELECT doc_id, text AS raw, CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, chr(10), ' ') END AS fixed FROM documents)
SELECT doc_id, len(list_filter(string_split(fixed, chr(10)), lambda x: trim(x, ' ') <> '')) < len(list_filter(string_split(raw, chr(10)), lambda x: trim(x, ' ') <> '')) AS loses_structure,
CASE WHEN length(trim(left(raw, doc_id % 300), ' ')) BETWEEN 1 AND 200 THEN trim(left(raw, doc_id % 300), ' ') ELSE lang_ END AS title FROM s JOIN (SELECT doc_id, lang AS lang_ FROM documents) USING (doc_id)"""
)
def text_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that lost lines, and titles that can be used."""
    flat = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        X.drops_structure(F.col("text"), flat).alias("loses_structure"),
        X.usable_title(F.left("text", (F.col("doc_id") % 300).cast("int")), F.col("lang")).alias("title"),
    )
