"""Queries of sequential segmentation and of boundary models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import learn as L
from quirewise.operators import sequential as Q
from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .views import GOLD_STARTS, PAGES, PRED_STARTS, SIZES, gold, predicted, turn_view


@query(f"WITH {PAGES} SELECT doc_id, page AS start FROM pages_v WHERE page = 1 OR length(text) % 5 = 0")
def adjacent_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts by verdicts on adjacent pages."""
    paged = pages(spark, sf_dir)
    verdicts = paged.where("page > 1").select("doc_id", "page", (F.length("text") % 5 == 0).alias("is_new"))
    return Q.adjacent_starts(paged, verdicts)


@query(f"WITH {PAGES}, {SIZES}, {PRED_STARTS} SELECT doc_id, unnest(range(1, n + 1, 10)) AS start FROM sizes UNION SELECT doc_id, start FROM pred")
def chunked_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts found by chunks that do not see each other."""
    paged = pages(spark, sf_dir)
    return Q.chunked_starts(S.sizes_of(paged), predicted(paged), 10)


@query(
    f"""WITH RECURSIVE {PAGES}, {SIZES}, w(doc_id, first, page, fresh) AS (SELECT doc_id, 1::BIGINT, 1::BIGINT, true FROM sizes
UNION ALL SELECT p.doc_id, CASE WHEN (length(p.text) + w.first) % 4 = 0 THEN p.page ELSE w.first END, p.page, (length(p.text) + w.first) % 4 = 0
FROM w JOIN pages_v p ON p.doc_id = w.doc_id AND p.page = w.page + 1) SELECT doc_id, page AS start FROM w WHERE fresh"""
)
def accumulated_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of spans grown page by page: a verdict depends on where the span began."""
    # A verdict is a rule on the page's length and the span's first page; only 4 rests differ.
    rests = F.array((4 - F.length("text") % 4) % 4)
    return Q.accumulated_by_rule(pages(spark, sf_dir).select("doc_id", "page", rests.alias("rests")), 4)


@query(f"WITH {PAGES}, {GOLD_STARTS} SELECT * FROM gold")
def probed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts by probing ranges: with right verdicts all true ones are found."""
    from pyspark.sql import Window

    paged = pages(spark, sf_dir)
    begins = F.when((F.col("page") == 1) | (F.length("text") % 5 == 0), 1).otherwise(0)
    upto = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    labelled = paged.select("doc_id", "page", F.sum(begins).over(upto).alias("label"))
    return Q.probed_by_label(labelled, gold(paged).where("start % 20 = 0"))


@query(
    f"""WITH RECURSIVE {PAGES}, {SIZES}, lb AS MATERIALIZED (SELECT doc_id, page, length(text) AS len, sum(CASE WHEN page = 1 OR length(text) % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS label FROM pages_v),
edge AS (SELECT doc_id, 1 AS low FROM sizes UNION SELECT doc_id, page FROM lb WHERE page > 1 AND page % 8 = 0),
seg AS MATERIALIZED (SELECT doc_id, low, coalesce(lead(low) OVER (PARTITION BY doc_id ORDER BY low) - 1, n) AS high FROM edge JOIN sizes USING (doc_id)),
sure AS MATERIALIZED (SELECT doc_id, page FROM lb WHERE len % 5 = 0 OR len % 7 = 0),
f(doc_id, low, high, start, known, last, step, found, ask, emitted) AS (SELECT doc_id, low, high, low, low, low, 1::BIGINT, NULL::BIGINT, low + 1, NULL::BIGINT FROM seg WHERE low < high
UNION ALL SELECT doc_id, low, high, CASE WHEN b IS NOT NULL THEN b ELSE start END, CASE WHEN b IS NOT NULL THEN b WHEN there THEN found2 ELSE known END, CASE WHEN b IS NOT NULL THEN b WHEN there THEN found2 ELSE last2 END,
CASE WHEN there THEN 1 ELSE step2 END, CASE WHEN there THEN NULL ELSE found2 END,
CASE WHEN there THEN CASE WHEN coalesce(b, found2) < high THEN coalesce(b, found2) + 1 END WHEN found2 IS NOT NULL THEN (last2 + found2) // 2 ELSE least(known + step2, high) END, b
FROM (SELECT *, CASE WHEN b0 <= start THEN found2 ELSE b0 END AS b FROM (SELECT t3.*, CASE WHEN there THEN CASE WHEN s0.page IS NOT NULL THEN found2 WHEN sm.page IS NOT NULL AND found2 - 1 > low THEN found2 - 1 WHEN sp.page IS NOT NULL AND found2 + 1 <= high THEN found2 + 1 END END AS b0
FROM (SELECT *, coalesce(found2 - last2 <= 1, false) AS there FROM (SELECT *, CASE WHEN nw THEN ask ELSE found END AS found2, CASE WHEN nw THEN last ELSE ask END AS last2, CASE WHEN found IS NULL AND NOT nw THEN step * 2 ELSE step END AS step2
FROM (SELECT f.*, (p.label <> s.label) <> ((f.start * 7 + f.ask * 3 + p.len) % 23 = 0) AS nw FROM f JOIN lb s ON s.doc_id = f.doc_id AND s.page = f.start JOIN lb p ON p.doc_id = f.doc_id AND p.page = f.ask) t1
WHERE NOT (found IS NULL AND NOT nw AND ask = high)) t2) t3
LEFT JOIN sure s0 ON s0.doc_id = t3.doc_id AND s0.page = found2 LEFT JOIN sure sm ON sm.doc_id = t3.doc_id AND sm.page = found2 - 1 LEFT JOIN sure sp ON sp.doc_id = t3.doc_id AND sp.page = found2 + 1) t4) t5)
SELECT doc_id, low AS start FROM seg UNION SELECT doc_id, emitted FROM f WHERE emitted IS NOT NULL"""
)
def frontier_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts by probing all documents at once; one verdict in 23 is wrong, and boundaries need a confirmation."""
    from pyspark.sql import Window

    from quirewise.operators.graph import checkpoint

    paged = pages(spark, sf_dir)
    begins = F.when((F.col("page") == 1) | (F.length("text") % 5 == 0), 1).otherwise(0)
    upto = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    facts = checkpoint(paged.select("doc_id", "page", F.length("text").alias("len"), F.sum(begins).over(upto).alias("label")))

    blocks = checkpoint(Q.page_blocks(facts, ["len", "label"]))

    def ask(questions: DataFrame, small: Q.Small) -> DataFrame:
        start, page = F.col("_facts")[F.col("start")], F.col("_facts")[F.col("ask")]
        held = blocks.select("doc_id", F.col("block").alias("_block"), F.col("facts").alias("_facts"))
        at = lambda df, c: df.withColumn("_block", Q.block_of(F.col(c))).join(held, ["doc_id", "_block"])
        begun = at(questions, "start").withColumn("label_s", start["label"]).drop("_block", "_facts")
        met = at(small(begun), "ask").withColumns({"label": page["label"], "len": page["len"]}).drop("_block", "_facts")
        wrong = (F.col("start") * 7 + F.col("ask") * 3 + F.col("len")) % 23 == 0
        return met.withColumn("is_new", (F.col("label") != F.col("label_s")) != wrong).drop("label", "label_s", "len")

    sure = facts.where("len % 5 = 0 OR len % 7 = 0").select("doc_id", "page")
    cuts = facts.where("page % 8 = 0").select("doc_id", F.col("page").alias("start"))
    return Q.frontier_starts(S.sizes_of(facts), ask, sure, cuts)


@query(
    """WITH t AS (SELECT conv_id, turn, role AS bucket, 'd' || length(text) % 2 AS date, turn * 10 + 1 AS start, turn * 10 + 1 + length(text) % 8 AS "end" FROM conversations),
l AS (SELECT *, lag(bucket) OVER w AS b, lead(bucket) OVER w AS a, lag(date) OVER w AS d FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(b = bucket AND d = date OR (b = a AND b <> bucket AND "end" - start + 1 <= 5), false) AND turn % 4 <> 0 AS suspect FROM l"""
)
def older_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries that an older rule suspects; seams are exempt."""
    rows = turn_view(spark, sf_dir).select(
        "conv_id", "turn", F.col("role").alias("bucket"), F.concat(F.lit("d"), (F.length("text") % 2).cast("string")).alias("date"), "start", "end"
    )
    return Q.older_suspicion(rows, "conv_id", "turn", F.col("turn") % 4 == 0).select("conv_id", "turn", "suspect")


@query()
def boundary_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page follows the end of a sentence, scored by models of the other languages."""
    from pyspark.sql import Window

    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    share = lambda p: F.coalesce(F.try_divide(F.regexp_count("text", F.lit(p)).cast("double"), F.length("text").cast("double")), F.lit(0.0))
    by_page = Window.partitionBy("doc_id").orderBy("page")
    before = F.lag("text").over(by_page)
    rows = pages(spark, sf_dir).withColumn("before", before).where("page > 1").join(langs, "doc_id").select(
        "doc_id", "page", "lang", F.coalesce(F.col("before").rlike(r"[.!?]\s*$"), F.lit(False)).cast("int").alias("label"),
        F.log1p(F.length("text")).alias("size"), F.log1p(F.length("before")).alias("size_before"),
        F.col("text").rlike(r"^\s*\p{Lu}").cast("double").alias("opens"), share(r"\p{Lu}").alias("capitals"), share("[0-9]").alias("digits"),
        F.log1p("page").alias("place"),
    )
    scored = L.leave_one_out(rows, "lang", ["size", "size_before", "opens", "capitals", "digits", "place"], "label")
    return scored.select("doc_id", "page", "lang", "label", "score")


@query(
    r"""WITH w AS (SELECT d.doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w, d.doc_id IN (SELECT doc_id FROM labels) AS tr FROM documents d),
t AS (SELECT doc_id, tr, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS MATERIALIZED (SELECT doc_id, tr, term, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(n) AS tf FROM c WHERE tr GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 20000),
x AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM w WHERE tr)) / (1.0 + df)) + 1) AS a FROM c JOIN v USING (term))
SELECT doc_id, count(*) AS n_terms, round(sum(a) / sqrt(sum(a * a)), 6) AS total, round(max(a) / sqrt(sum(a * a)), 6) AS top FROM x GROUP BY doc_id"""
)
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word and pair weights, by a vocabulary of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    found = L.tfidf(train, docs, "doc_id", "text", most_terms=20_000)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))
