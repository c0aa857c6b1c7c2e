"""Queries of summaries around replies of models, and of the notices in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import text as X
from quirewise.operators import reports as R
from quirewise.operators import rows as W
from quirewise.operators import summaries as Z
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .views import PAGES, turn_view

_LOST = f"""{PAGES}, lost AS (SELECT doc_id, list_sort(list(page)) AS p FROM pages_v WHERE length(text) % 17 = 0 AND page > 1 GROUP BY doc_id)"""
_PHRASE = "CASE WHEN len(p) = 1 THEN 'page ' || p[1] ELSE 'pages ' || array_to_string(p[:-2], ', ') || ' and ' || p[-1] END"


@query(
    f"""WITH {_LOST} SELECT doc_id, 'Unintelligible: the text recognizer could not read ' || {_PHRASE} || ' of this document, so there was no text to summarize.' AS whole,
'Unintelligible: the text recognizer could not read ' || {_PHRASE} || ' of this document, so that content is not covered by this summary.' AS part FROM lost"""
)
def unreadable_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary says of the pages that could not be read."""
    lost = pages(spark, sf_dir).where((F.length("text") % 17 == 0) & (F.col("page") > 1)).groupBy("doc_id").agg(F.collect_list("page").alias("p"))
    return lost.select("doc_id", Z.unreadable_notice(F.col("p")).alias("whole"), Z.partial_notice(F.col("p")).alias("part"))


_ROW = """r AS (SELECT conv_id, turn, text, length(coalesce(text, '')) AS n, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN '' ELSE coalesce(text, '') END AS src,
CASE length(coalesce(text, '')) % 4 WHEN 0 THEN '9' WHEN 1 THEN '3' ELSE '100' END AS category, CASE WHEN length(coalesce(text, '')) % 9 = 0 THEN 'x' ELSE '' END AS flag,
CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN '-' ELSE '01/02/24' END AS injury, length(coalesce(text, '')) % 5 = 0 AS lost FROM conversations),
m AS (SELECT *, trim(src) <> '' AS has, n % 6 = 0 AS failed, '**Body**: ' || src AS body, 'short ' || turn AS fallback,
CASE n % 4 WHEN 0 THEN 'plain ' || src ELSE '**Body**: ' || replace(src, 'e', 'E') END AS fixed, CASE WHEN n % 3 = 1 THEN ['capitalization'] WHEN n % 3 = 2 THEN ['unsupported'] ELSE [] END AS issues, n % 10 = 0 AS audit_failed,
CASE WHEN n % 13 = 0 THEN repeat('t', 201) ELSE 'Title ' || turn END AS made FROM r),
a AS (SELECT *, CASE WHEN failed THEN fallback ELSE body END AS b, CASE WHEN injury = '-' THEN '' ELSE '**DOI**: ' || injury || '. ' END AS lead_,
CASE WHEN lost THEN ' Unintelligible: the text recognizer could not read pages 2 and 3 of this document, so that content is not covered by this summary.' ELSE '' END AS tail,
CASE WHEN length(made) <= 200 THEN made ELSE 'Row ' || turn END AS t, has AND NOT audit_failed AS ran FROM m),
k AS (SELECT *, NOT (n % 3 = 1 AND len(regexp_extract_all(fixed, '\\*\\*(.+?)\\*\\*')) < len(regexp_extract_all(b, '\\*\\*(.+?)\\*\\*')))
 AND NOT (category = '9' AND (len(list_filter(string_split(fixed, chr(10)), lambda x: trim(x, ' ') <> '')) < len(list_filter(string_split(b, chr(10)), lambda x: trim(x, ' ') <> '')))) AS keeps FROM a)"""
_DRESS = "CASE WHEN flag = 'x' THEN '[ManualCheck] ' ELSE '' END || {} || CASE WHEN category = '3' THEN ' [Diagnostic Study]' ELSE '' END || ' (Pages ' || turn || '-' || turn + 1 || ')'"


@query(
    f"""WITH {_ROW} SELECT conv_id, turn, CASE WHEN has THEN {_DRESS.format('t')} ELSE {_DRESS.format("'Row ' || turn")} END AS title,
CASE WHEN has THEN lead_ || b || tail WHEN lost THEN 'Unintelligible: the text recognizer could not read pages 2 and 3 of this document, so there was no text to summarize.' ELSE 'There was no text to summarize.' END AS text,
ran AS verified, CASE WHEN ran AND len(issues) > 0 AND keeps THEN lead_ || fixed || tail END AS verified_text, CASE WHEN ran AND len(issues) > 0 AND n % 2 = 0 THEN {_DRESS.format("'Fixed ' || turn")} END AS verified_title,
CASE WHEN has THEN CASE WHEN failed THEN 'small' ELSE 'large' END END AS model, CASE WHEN has AND failed THEN 'large' END AS fallback_from, NOT has AS notice_only FROM k"""
)
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every turn, with replies in place of the models."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n, turn = F.length("text"), F.col("turn")
    source = F.when(n % 7 == 0, "").otherwise(F.col("text"))
    rows = turns.select(
        "conv_id", "turn", turn.alias("start"), (turn + 1).alias("end"),
        F.when(n % 4 == 0, "9").when(n % 4 == 1, "3").otherwise("100").alias("category"), F.lit("-").alias("date"),
        F.when(n % 3 == 0, "-").otherwise("01/02/24").alias("injury_date"), F.when(n % 9 == 0, "x").otherwise("").alias("flag"),
        F.concat(F.lit("Row "), turn.cast("string")).alias("title"), source.alias("text"),
        F.when(n % 5 == 0, F.array(F.lit(3), F.lit(2))).alias("unreadable"),
    )
    body = F.concat(F.lit("**Body**: "), source)
    replies = turns.select(
        "conv_id", "turn", body.alias("body"), (n % 6 == 0).alias("failed"), F.concat(F.lit("short "), turn.cast("string")).alias("fallback_body"),
        F.when(n % 13 == 0, F.lit("t" * 201)).otherwise(F.concat(F.lit("Title "), turn.cast("string"))).alias("made_title"),
        F.when(n % 4 == 0, F.concat(F.lit("plain "), source)).otherwise(F.concat(F.lit("**Body**: "), F.replace(source, F.lit("e"), F.lit("E")))).alias("fixed"),
        F.when(n % 2 == 0, F.concat(F.lit("Fixed "), turn.cast("string"))).alias("fixed_title"),
        F.when(n % 3 == 1, F.array(F.lit("capitalization"))).when(n % 3 == 2, F.array(F.lit("unsupported"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        (n % 10 == 0).alias("audit_failed"),
    )
    return Z.summarise(rows, replies, ["conv_id", "turn"], "large", "small").drop("date")


@query(
    """WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), v AS (SELECT doc_id, '**' || replace(t, chr(10), '** **') || '**' AS raw, '**' || replace(t, chr(10), ' ') || '**' AS fixed, length(t) % 3 AS k FROM r)
SELECT doc_id, k < 2 AND len(regexp_extract_all(fixed, '\\*\\*(.+?)\\*\\*')) < len(regexp_extract_all(raw, '\\*\\*(.+?)\\*\\*')) AS drops FROM v"""
)
def heading_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that lose headings without a reason to."""
    text = F.coalesce("text", F.lit(""))
    mark = lambda t, by: F.concat(F.lit("**"), F.replace(t, F.lit("\n"), F.lit(by)), F.lit("**"))
    k = F.length(text) % 3
    issues = F.when(k == 0, F.array(F.lit("capitalization"))).when(k == 1, F.array(F.lit("range_of_motion"), F.lit("capitalization"))).otherwise(F.array(F.lit("other")))
    return table(spark, sf_dir, "documents").select("doc_id", X.drops_headings(mark(text, "** **"), mark(text, " "), issues, Z.CORRECTIONS).alias("drops"))


@query(
    """SELECT conv_id, turn FROM conversations WHERE length(coalesce(text, '')) % 4 = 0 AND length(coalesce(text, '')) % 3 <> 0 AND turn % 2 = 0"""
)
def retryable_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that only say what could not be read, untouched by anybody."""
    n = F.length(F.coalesce("text", F.lit("")))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (n % 4 == 0).alias("unreadable"), F.when(n % 3 == 0, "m").alias("model"),
        F.when(F.col("turn") % 2 == 1, "edit").alias("edited_title"), none.alias("edited_text"), none.alias("edited_date"),
    )
    return R.retryable_notices(rows).select("conv_id", "turn")


@query(
    """WITH r AS (SELECT source, doc_id, length(coalesce(text, '')) % 3 = 0 AS ok FROM documents), g AS (SELECT count(*) FILTER (WHERE ok) AS n FROM r) SELECT doc_id FROM r, g WHERE ok AND n > 0"""
)
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten bodies that succeeded; none if all failed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(F.coalesce("text", F.lit(""))) % 3 == 0).alias("ok"))
    return R.all_or_abort(rows, F.col("ok")).select("doc_id")


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^\\s*\\[ManualCheck\\]\\s*', '', 'i'), '\\s*\\(Pages\\s+\\d+\\s*[-–]\\s*\\d+\\)\\s*$', '', 'i'), '\\s*\\[Diagnostic Study\\]\\s*$', '', 'i') AS title,
CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '1/2/2024' ELSE '1/2/2024 & 03-04-24' END AS injury, x AS body
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[ManualCheck] ' ELSE '' END || 'Visit ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN ' [Diagnostic Study]' ELSE '' END || ' (Pages 1-' || doc_id || ')' AS t, coalesce(text, '') AS x FROM documents)"""
)
def display_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, injury dates and body of summaries as they are shown."""
    i = F.col("doc_id")
    title = F.concat(
        F.when(i % 2 == 0, "[ManualCheck] ").otherwise(""), F.lit("Visit "), i.cast("string"),
        F.when(i % 5 == 0, " [Diagnostic Study]").otherwise(""), F.lit(" (Pages 1-"), i.cast("string"), F.lit(")"),
    )
    lead = F.when(i % 3 == 0, "").when(i % 3 == 1, "**DOI**: 1/2/2024. ").otherwise("**DOI**: 1/2/2024 & 03-04-24. ")
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("doc_id", *X.display_parts(F.col("title"), F.col("text")))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS patient_first_name, split_part(c_name, '#', 2) AS patient_last_name, CAST(c_nationkey AS VARCHAR) AS patient_dob, '' AS law_firm FROM customer")
def header_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields under the names they are stored by."""
    parts = F.split("c_name", "#")
    read = table(spark, sf_dir, "customer").select(
        "c_custkey", F.get(parts, F.lit(0)).alias("first_name"), F.get(parts, F.lit(1)).alias("last_name"), F.col("c_nationkey").cast("string").alias("dob"),
        F.lit(None).cast("string").alias("lawfirm"),
    )
    return W.header_shape(read)


@query("SELECT conv_id, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of one category each record has."""
    return R.category_total(turn_view(spark, sf_dir), "conv_id", "user")
