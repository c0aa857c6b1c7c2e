"""Queries of the classification cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import classify as C
from quirewise.registry import query
from quirewise.sources.tables import table

#: Kinds of documents, one of which is put behind each web page's own title, by the page's number.
KINDS = (
    "Covering note to the operative report", "Fax transmittal letter", "Supplemental report of the agreed medical evaluator", "Deposition of the applicant, volume II",
    "Proof of service by mail", "Certificate of mailing", "Progress note, primary treating physician", "Permanent and stationary evaluation", "Surgical pathology",
    "Laboratory panel", "Utilization review denial", "Independent medical review decision", "Voucher for return to work", "Authorization request", "Emergency room registration",
    "Notes of nothing in particular", "Daily therapy note", "Notice of qualified medical evaluator appointment", "Claim application", "Radiograph of the left wrist",
    "Index of records", "Patient information sheet", "Medication administration chart", "Ultrasound, abdomen",
)


def _sql_rules() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    hits = ", ".join(f"CASE WHEN regexp_matches(t, {quote(p)}) THEN '{c}' END" for p, c in C.RULES)
    paper = " OR ".join(f"regexp_matches(t, {quote(p)})" for p in C.PAPERWORK)
    return f"""h AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS f, {paper} AS paperwork,
  regexp_matches(t, {quote(C.DOCUMENT_NOUN)}) AND NOT regexp_matches(t, {quote(C.ABOUT_A_DOCUMENT)}) AS document FROM tt),
k AS (SELECT *, CASE WHEN list_has_any(f, ['3', '8', '9', '14']) THEN list_filter(f, lambda x: x <> '13') ELSE f END AS kept FROM h),
rl AS (SELECT *, CASE WHEN NOT paperwork OR document THEN kept[1] ELSE coalesce(list_filter(kept, lambda x: x <> '13')[1], '100') END AS rule FROM k)"""


_TITLED = (
    f"tt AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || [{', '.join(repr(k) for k in KINDS)}][page_id % {len(KINDS)} + 1]) AS t FROM pages)"
)


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("page_id") % len(KINDS))
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" "), kind)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"))


@query(f"WITH {_TITLED}, {_sql_rules()} SELECT page_id, rule AS category FROM rl")
def rules_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category that each title's wording decides."""
    return _titled(spark, sf_dir).select("page_id", C.by_rules(F.col("title")).alias("category"))


@query(
    f"""WITH {_TITLED}, {_sql_rules()}, o AS (SELECT page_id, rule, CASE WHEN page_id % 5 > 0 THEN CAST(page_id % 3 AS VARCHAR) END AS vec, CASE WHEN page_id % 7 > 0 THEN CAST(page_id % 2 AS VARCHAR) END AS vote FROM rl)
SELECT page_id, coalesce(rule, vote, vec, '100') AS category, CASE WHEN rule IS NOT NULL OR vec = vote THEN 'high' ELSE 'low' END AS confidence,
CASE WHEN rule IS NOT NULL THEN 'rules' WHEN vec IS NULL AND vote IS NULL THEN 'default' WHEN vote IS NULL THEN 'embedding' WHEN vec = vote THEN 'agreement' ELSE 'vote' END AS method,
NOT (rule IS NOT NULL OR coalesce(vec = vote, false)) AS needs_review FROM o"""
)
def vote_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, nearest vector and vote fused into one opinion."""
    i = F.col("page_id")
    vector = F.when(i % 5 > 0, (i % 3).cast("string"))
    vote = F.when(i % 7 > 0, (i % 2).cast("string"))
    return _titled(spark, sf_dir).select("page_id", C.fuse(C.by_rules(F.col("title")), vector, vote).alias("o")).select("page_id", "o.*")


@query(
    """WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL),
d AS (SELECT vec_id, c.label, sum(v * m) AS s FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, arg_max(label, s) AS category, round(max(s), 6) AS similarity FROM d GROUP BY vec_id"""
)
def nearest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest category, by the labels' mean vectors."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
    categories = means.groupBy(F.col("label").alias("category")).agg(ordered.alias("vector"))
    return C.nearest_category(rows, categories, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH s AS (SELECT l.doc_id, quality AS label, (n_chars % 1000) / 1000.0 AS score FROM labels l JOIN documents USING (doc_id)), g AS (SELECT i / 10.0 AS threshold FROM range(0, 10) r(i)),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM s, g GROUP BY 1),
f AS (SELECT threshold, tp, fp, fn, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, round(f1, 9) AS f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over a grid of thresholds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumnRenamed("quality", "label")
    return C.best_threshold(rows, [i / 10 for i in range(10)]).withColumn("f1", F.round("f1", 9))


@query(
    """WITH w AS (SELECT DISTINCT source AS role, CAST(doc_id % 4 AS VARCHAR) AS category FROM documents), c AS (SELECT DISTINCT source AS role, CASE WHEN doc_id % 4 = 3 THEN '100' ELSE CAST(doc_id % 4 AS VARCHAR) END AS category FROM documents WHERE doc_id % 9 = 0)
SELECT w.role, w.category, coalesce(c.role || c.category, CASE WHEN w.category IN ('0', '1') THEN 'code' || w.category END, g.role || g.category, 'code100') AS prompt
FROM w LEFT JOIN c ON c.role = w.role AND c.category = w.category LEFT JOIN c g ON g.role = w.role AND g.category = '100'"""
)
def prompt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by role and category: custom before built in, general last."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("role"), (F.col("doc_id") % 4).cast("string").alias("category"), "doc_id")
    wanted = docs.select("role", "category").distinct()
    named = F.when(F.col("category") == "3", C.GENERAL).otherwise(F.col("category"))
    custom = docs.where("doc_id % 9 = 0").select("role", named.alias("category")).distinct().withColumn("text", F.concat("role", "category"))
    kinds = F.explode(F.array(F.lit("0"), F.lit("1"), F.lit(C.GENERAL)))
    builtin = wanted.select("role").distinct().select("role", kinds.alias("category")).withColumn("text", F.concat(F.lit("code"), "category"))
    return C.resolve_prompts(wanted, custom, builtin)


@query()
def fuzzy_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of each part's name by the brand whose names are most like it."""
    parts = table(spark, sf_dir, "part")
    names = parts.groupBy(F.col("p_type").alias("category")).agg(F.min("p_name").alias("title"), F.min("p_partkey").alias("place"))
    return C.fuzzy_category(parts.select("p_partkey", F.concat_ws(" ", "p_name", F.lit("no. 1")).alias("title")), names, "p_partkey")


@query(r"""SELECT page_id, lower(trim(regexp_replace(coalesce(html, 'Unknown'), '[^a-zA-Z0-9\s]', '', 'g'), ' ')) AS k FROM pages""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts as titles are compared: letters, digits and blanks."""
    from quirewise.functions.text import title_key

    return table(spark, sf_dir, "pages").select("page_id", title_key(F.col("html")).alias("k"))


@query("SELECT doc_id, CASE WHEN n_chars % 70 / 10.0 >= 5 THEN 'strong' WHEN n_chars % 70 / 10.0 >= 2 THEN 'useful' WHEN n_chars % 70 / 10.0 >= 1.2 THEN 'weak' ELSE 'none' END AS band FROM documents")
def signal_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lifts of these sizes are worth."""
    from quirewise.operators.learn import signal_band

    return table(spark, sf_dir, "documents").select("doc_id", signal_band(F.col("n_chars") % 70 / 10.0).alias("band"))


@query(
    f"""WITH {_TITLED}, {_sql_rules()}, o AS (SELECT page_id, rule, CASE WHEN page_id % 5 > 0 THEN CAST(page_id % 3 AS VARCHAR) END AS vec, CASE WHEN page_id % 7 > 0 THEN CAST(page_id % 2 AS VARCHAR) END AS vote FROM rl),
a AS (SELECT page_id, coalesce(rule, vote, vec, '100') AS category, NOT (rule IS NOT NULL OR coalesce(vec = vote, false)) AS needs_review FROM o),
b AS (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN CAST(page_id % 2 AS VARCHAR) END AS vec, CASE WHEN page_id % 9 > 0 THEN CAST(page_id % 2 AS VARCHAR) END AS vote FROM pages WHERE page_id % 10 > 0),
c AS (SELECT a.page_id, coalesce(a.needs_review AND page_id % 6 > 0 AND b.page_id IS NOT NULL, false) AS twice, a.category AS c1, a.needs_review AS r1, coalesce(vote, vec, '100') AS c2, NOT coalesce(vec = vote, false) AS r2 FROM a LEFT JOIN b USING (page_id))
SELECT page_id, CASE WHEN twice THEN c2 ELSE c1 END AS category, CASE WHEN twice THEN r2 ELSE r1 END AS needs_review,
CASE WHEN (CASE WHEN twice THEN r2 ELSE r1 END) OR page_id % 8 = 1 THEN 'x' ELSE '' END AS flag FROM c"""
)
def escalated_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of titles, those in doubt asked again with their pages' text; what stays in doubt is flagged."""
    i = F.col("page_id")
    flag = F.when(i % 8 == 1, " X").otherwise("")
    first = C.fuse(C.by_rules(F.col("title")), F.when(i % 5 > 0, (i % 3).cast("string")), F.when(i % 7 > 0, (i % 2).cast("string")))
    rows = _titled(spark, sf_dir).select("page_id", flag.alias("flag"), first.alias("o")).select("page_id", "flag", "o.*")
    every = table(spark, sf_dir, "pages")
    texts = every.select("page_id", F.when(i % 6 > 0, F.col("html")).otherwise(" \n").alias("text"))
    none = F.lit(None).cast("string")
    second = C.fuse(none, F.when(i % 4 > 0, (i % 2).cast("string")), F.when(i % 9 > 0, (i % 2).cast("string")))
    again = every.where(i % 10 > 0).select("page_id", second.alias("o")).select("page_id", "o.*")
    return C.escalated(rows, texts, again, "page_id").select("page_id", "category", "needs_review", "flag")


@query(
    f"""WITH {_TITLED} SELECT page_id, CASE WHEN regexp_matches(t, 'report|note') THEN 'report' WHEN regexp_matches(t, 'letter|notice') THEN 'letter' WHEN regexp_matches(t, 'records?\\b') THEN 'record' ELSE 'other' END AS bucket FROM tt"""
)
def type_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bucket whose pattern each title matches."""
    patterns = [("report", "report|note"), ("letter", "letter|notice"), ("record", r"records?\b")]
    return _titled(spark, sf_dir).select("page_id", C.buckets(F.col("title"), patterns).alias("bucket"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN 1 THEN (event_id % 90) + 0.5 WHEN 2 THEN event_id % 7 END AS seconds FROM events"""
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seconds that duration texts state; what is no duration gives none."""
    from quirewise.functions import text as X

    i = F.col("event_id")
    n = (i % 90).cast("string")
    said = (
        F.when(i % 5 == 0, F.concat(n, F.lit("s"))).when(i % 5 == 1, F.concat(F.lit(" "), n, F.lit(".5s ")))
        .when(i % 5 == 2, F.concat((i % 7).cast("string"), F.lit(".0s"))).when(i % 5 == 3, F.concat(n, F.lit("ms")))
    )
    return table(spark, sf_dir, "events").select("event_id", X.seconds(said).alias("seconds"))
