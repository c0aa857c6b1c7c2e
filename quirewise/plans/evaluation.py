"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import evaluate as E
from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .views import GOLD_SPANS, GOLD_STARTS, PAGES, PRED_SPANS, PRED_STARTS, SIZES, gold, predicted, predicted_all

_BOTH = f"{PAGES}, {SIZES}, {GOLD_STARTS}, {PRED_STARTS}, {GOLD_SPANS}, {PRED_SPANS}"
_R = "round({}, 9)"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    return S.tile(predicted_all(paged), sizes), S.tile(gold(paged), sizes)


@query(
    """WITH c AS (SELECT d.lang, count(*) FILTER (WHERE quality = 1 AND n_chars % 3 > 0) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars % 3 > 0) AS fp,
count(*) FILTER (WHERE quality = 1 AND n_chars % 3 = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars % 3 = 0) AS tn FROM labels JOIN documents d USING (doc_id) GROUP BY 1),
x AS (SELECT lang, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, (tp + fp + fn + tn)::DOUBLE AS n FROM c),
y AS (SELECT *, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS ch FROM x)
SELECT lang, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) END AS mcc,
round(coalesce(((tp + tn) / n - ch) / nullif(1 - ch, 0), 0), 9) AS kappa, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy FROM y"""
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of a flag with the labels, by language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    counts = E.confusion(rows, F.col("quality") == 1, F.col("n_chars") % 3 > 0, ["lang"])
    return _rounded(E.boundary_metrics(counts), "precision", "recall", "f1", "mcc", "kappa", "balanced_accuracy")


@query(
    f"""WITH {_BOTH}, b AS (SELECT doc_id, count(*) AS nb, sum(p."end" - p.start + 1) AS wb FROM pred_spans p JOIN gold_spans g USING (doc_id, start, "end") GROUP BY 1),
p AS (SELECT doc_id, count(*) AS np, sum("end" - start + 1) AS wp FROM pred_spans GROUP BY 1), g AS (SELECT doc_id, count(*) AS ng, sum("end" - start + 1) AS wg FROM gold_spans GROUP BY 1)
SELECT doc_id, round(2.0 * coalesce(nb, 0) / (np + ng), 9) AS exact_f1, round(2.0 * coalesce(wb, 0) / (wp + wg), 9) AS weighted_f1, round(np / ng::DOUBLE, 9) AS over_segmentation
FROM p JOIN g USING (doc_id) LEFT JOIN b USING (doc_id)"""
)
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of whole spans, plain and by their pages, and the ratio of their numbers."""
    return _rounded(E.span_scores(*_spans(spark, sf_dir)), "exact_f1", "weighted_f1", "over_segmentation")


_NEAR = """nr AS (SELECT g.doc_id, g.start, arg_min(p.start, abs(p.start - g.start) * 100000 + p.start) AS near FROM gold g LEFT JOIN pred_all p USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {_BOTH}, {_NEAR} SELECT doc_id, round(avg(abs(near - start)), 9) AS mean_offset FROM nr GROUP BY doc_id")
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean distance from a true start to the nearest predicted one."""
    paged = pages(spark, sf_dir)
    near = E.nearest(gold(paged), predicted_all(paged))
    return near.groupBy("doc_id").agg(F.round(F.avg(F.abs(F.col("near") - F.col("start"))), 9).alias("mean_offset"))


@query(
    f"""WITH {_BOTH}, {_NEAR}, ex AS (SELECT p.doc_id, p.start, min(abs(g.start - p.start)) AS d FROM pred_all p LEFT JOIN gold g USING (doc_id) GROUP BY ALL)
SELECT doc_id, start, CASE WHEN near = start THEN 'exact' WHEN abs(near - start) <= 2 THEN 'shifted' ELSE 'missed' END AS kind FROM nr
UNION ALL SELECT doc_id, start, 'extra' FROM ex WHERE coalesce(d > 2, true)"""
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every start."""
    paged = pages(spark, sf_dir)
    return E.triage(predicted_all(paged), gold(paged))


@query(
    f"""WITH {_BOTH}, s AS (SELECT p.doc_id, p.start, arg_min(g.start, abs(g.start - p.start) * 100000 + g.start) AS near FROM pred_all p JOIN gold g USING (doc_id) GROUP BY ALL),
r AS (SELECT DISTINCT doc_id, near AS start FROM s WHERE abs(near - start) <= 2)
SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end" FROM r JOIN sizes USING (doc_id)"""
)
def recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as they would be with near starts snapped and far ones dropped."""
    paged = pages(spark, sf_dir)
    return S.tile(E.recovered(predicted_all(paged), gold(paged), 2), S.sizes_of(paged))


@query(
    f"""WITH {_BOTH}, m AS (SELECT v.doc_id, page, CASE WHEN g.start IS NULL THEN 0 ELSE 1 END AS ref, CASE WHEN p.start IS NULL THEN 0 ELSE 1 END AS hyp FROM pages_v v
  LEFT JOIN gold g ON g.doc_id = v.doc_id AND g.start = page LEFT JOIN pred_all p ON p.doc_id = v.doc_id AND p.start = page WHERE page > 1),
s AS (SELECT doc_id, count(*) OVER w AS n, sum(ref) OVER w AS r, sum(hyp) OVER w AS h FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT doc_id, round(avg(CASE WHEN r <> h THEN 1.0 ELSE 0 END), 9) AS windowdiff, round(avg(CASE WHEN (r > 0) <> (h > 0) THEN 1.0 ELSE 0 END), 9) AS pk FROM s WHERE n = 4 GROUP BY doc_id"""
)
def windowdiff_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window metrics of the boundaries after each page."""
    paged = pages(spark, sf_dir)
    mark = lambda df, name: df.select("doc_id", F.col("start").alias("page"), F.lit(1).alias(name)).distinct()
    marks = paged.where("page > 1").select("doc_id", "page").join(mark(gold(paged), "ref"), ["doc_id", "page"], "left")
    marks = marks.join(mark(predicted_all(paged), "hyp"), ["doc_id", "page"], "left").na.fill(0)
    return _rounded(E.window_metrics(marks, 4), "windowdiff", "pk")


@query(
    f"""WITH {_BOTH}, f AS (SELECT g.doc_id, g.start, bool_or(p.start = g.start AND p."end" = g."end") AS e, bool_and(p.start >= g.start AND p."end" <= g."end") AS o,
  bool_or(p.start <= g.start AND p."end" >= g."end") AS u FROM gold_spans g JOIN pred_spans p ON p.doc_id = g.doc_id AND p.start <= g."end" AND p."end" >= g.start GROUP BY ALL)
SELECT doc_id, count(*) FILTER (WHERE e) AS exact, count(*) FILTER (WHERE NOT e AND o) AS over_split, count(*) FILTER (WHERE NOT e AND NOT o AND u) AS under_split,
count(*) FILTER (WHERE NOT e AND NOT o AND NOT u) AS misaligned FROM f GROUP BY doc_id"""
)
def span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True spans found, split, merged or misaligned."""
    return E.span_match(*_spans(spark, sf_dir))


@query(
    f"""WITH {_BOTH}, k AS (SELECT unnest(range(-10, 11)) AS shift), h AS (SELECT g.doc_id, shift, count(*) AS hits FROM gold g, k, pred p WHERE p.doc_id = g.doc_id AND p.start = g.start + 3 - 3 + shift GROUP BY ALL)
SELECT doc_id, arg_max(shift, hits * 1000000 - abs(shift) * 1000 - shift) AS shift, max(hits) AS hits FROM h GROUP BY doc_id"""
)
def gold_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant offset that explains most of the predictions."""
    paged = pages(spark, sf_dir)
    return E.best_shift(predicted(paged), gold(paged))


_SCORED = "sc AS (SELECT quality AS label, (n_chars % 200) / 200.0 AS score FROM labels JOIN documents USING (doc_id))"
_CURVE = f"""{_SCORED}, t AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM sc GROUP BY 1),
cv AS (SELECT score::DOUBLE AS score, p, q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM t)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 200) / 200.0).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("score", F.col("quality").alias("label"))


@query(f"WITH {_CURVE} SELECT round(sum(p / np * tp / (tp + fp)), 9) AS average_precision, round(sum(q * (tp - p / 2.0)) / max(np * nq), 9) AS roc_auc FROM cv")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and area under the curve of a score."""
    return _rounded(E.average_precision(_scored(spark, sf_dir)), "average_precision", "roc_auc")


@query(f"WITH {_CURVE}, f AS (SELECT score, 2.0 * tp / (tp + fp + np) AS f1 FROM cv) SELECT score AS threshold, round(f1, 9) AS f1 FROM f ORDER BY round(f1, 12) DESC, score DESC LIMIT 1")
def oracle_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the best F1."""
    return _rounded(E.best_f1(_scored(spark, sf_dir)), "f1")


_RUNS = "rn AS (SELECT l_orderkey AS document, l_returnflag AS arm, l_linenumber AS rep, l_quantity AS metric FROM lineitem)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("rep"), F.col("l_quantity").alias("metric")
    )


@query(f"WITH {_RUNS} SELECT document, arm, round(avg(metric), 9) AS mean, min(metric) AS low, max(metric) AS high, count(*) AS n FROM rn GROUP BY ALL")
def ab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and range of every document and arm."""
    return _runs(spark, sf_dir).groupBy("document", "arm").agg(
        F.round(F.avg("metric"), 9).alias("mean"), F.min("metric").alias("low"), F.max("metric").alias("high"), F.count("*").alias("n")
    )


@query(
    f"WITH {_RUNS}, m AS (SELECT document, arm, avg(metric) AS m, sum(metric) AS s, count(*) AS n FROM rn GROUP BY ALL) SELECT arm, round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS pooled, count(*) AS documents FROM m GROUP BY arm"
)
def ab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of means by arm, and the ratio of the sums."""
    means = _runs(spark, sf_dir).groupBy("document", "arm").agg(F.avg("metric").alias("m"), F.sum("metric").alias("s"), F.count("*").alias("n"))
    return means.groupBy("arm").agg(
        F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.sum("s") / F.sum("n"), 6).alias("pooled"), F.count("*").alias("documents")
    )


@query(
    f"""WITH {_RUNS}, s AS (SELECT document, arm, avg(metric) AS m, max(metric) - min(metric) AS r, count(*) AS n FROM rn GROUP BY ALL)
SELECT a.document, round(b.m - a.m, 9) AS gap, greatest(a.r, b.r) AS noise, CASE WHEN a.n > 1 AND b.n > 1 THEN abs(b.m - a.m) > greatest(a.r, b.r) END AS clears
FROM s a JOIN s b ON a.document = b.document AND a.arm = 'A' AND b.arm = 'R'"""
)
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and noise of two arms; unmeasured is not false."""
    return _rounded(E.compare_arms(_runs(spark, sf_dir), "A", "R"), "gap")


@query(
    f"""WITH RECURSIVE {_RUNS}, s AS (SELECT document, arm, avg(metric) AS m FROM rn GROUP BY ALL),
g AS (SELECT b.m - a.m AS gap FROM s a JOIN s b ON a.document = b.document AND a.arm = 'A' AND b.arm = 'R'),
c AS (SELECT count(*) FILTER (WHERE gap > 0) AS wins, count(*) FILTER (WHERE gap < 0) AS losses, count(*) FILTER (WHERE gap = 0) AS ties FROM g),
k AS (SELECT *, wins + losses AS nn, unnest(range(greatest(wins, losses), wins + losses + 1)) AS i FROM c)
SELECT wins, losses, ties, round(CASE WHEN any_value(nn) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(nn + 1) - lgamma(i + 1) - lgamma(nn - i + 1) - nn * ln(2)))) END, 8) AS p_value FROM k GROUP BY ALL"""
)
def ab_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, losses and ties of two arms over all documents, with the exact test."""
    return E.outcome(E.compare_arms(_runs(spark, sf_dir), "A", "R")).withColumn("p_value", F.round("p_value", 8))


@query(
    f"""WITH {_RUNS} SELECT document, count(*) FILTER (WHERE arm = 'A') >= 2 AND count(*) FILTER (WHERE arm = 'R') >= 2 AS complete FROM rn GROUP BY document"""
)
def ab_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that every arm ran often enough."""
    return E.complete_documents(_runs(spark, sf_dir), ["A", "R"], 2)


@query(
    """WITH s AS (SELECT l_orderkey AS document, l_linenumber AS rep, l_suppkey % 5 + 1 AS page FROM lineitem), t AS (SELECT document, count(DISTINCT rep) AS n FROM s GROUP BY 1),
c AS (SELECT document, page, count(DISTINCT rep) AS c FROM s WHERE page > 1 GROUP BY ALL)
SELECT document, page, round(c / n::DOUBLE, 9) AS share, c < n AS unstable, c / n::DOUBLE > 0.5 AS majority FROM c JOIN t USING (document)"""
)
def ab_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In what share of runs a page starts something."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("rep"), (F.col("l_suppkey") % 5 + 1).alias("page")
    )
    return _rounded(E.votes(rows, rows), "share")


@query(
    f"""WITH RECURSIVE {_BOTH}, b AS (SELECT doc_id, start FROM pred_all), c AS (SELECT doc_id, page AS start FROM pages_v WHERE length(text) % 5 = 0 AND length(text) % 3 <> 0),
pg AS (SELECT doc_id, start, max(b) AS b, max(c) AS c, max(t) AS t FROM (SELECT *, 1 AS b, 0 AS c, 0 AS t FROM b UNION ALL SELECT *, 0, 1, 0 FROM c UNION ALL SELECT *, 0, 0, 1 FROM gold) WHERE start > 1 GROUP BY ALL),
n AS (SELECT doc_id, count(*) FILTER (WHERE b = t AND c <> t) AS base_only, count(*) FILTER (WHERE c = t AND b <> t) AS contender_only FROM pg GROUP BY doc_id),
k AS (SELECT doc_id, base_only, contender_only, base_only + contender_only AS nn, unnest(range(greatest(base_only, contender_only), base_only + contender_only + 1)) AS i FROM n)
SELECT doc_id, base_only, contender_only, round(CASE WHEN any_value(nn) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(nn + 1) - lgamma(i + 1) - lgamma(nn - i + 1) - nn * ln(2)))) END, 8) AS p_value FROM k GROUP BY ALL"""
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that one of two sides alone has right, with an exact test."""
    paged = pages(spark, sf_dir)
    n = F.length("text")
    contender = paged.where((n % 5 == 0) & (n % 3 != 0)).select("doc_id", F.col("page").alias("start"))
    found = E.mcnemar(predicted_all(paged), contender, gold(paged))
    return found.withColumn("p_value", F.round("p_value", 8))


@query(
    f"""WITH {_BOTH} SELECT doc_id, count(*) AS spans, round(avg("end" - start + 1), 9) AS mean_pages, median("end" - start + 1) AS median_pages, max("end" - start + 1) AS most_pages,
round(avg(CASE WHEN "end" = start THEN 1.0 ELSE 0 END), 9) AS single_share, min(start) - 1 AS front_gap, any_value(n) - max("end") AS tail_gap FROM gold_spans JOIN sizes USING (doc_id) GROUP BY doc_id"""
)
def span_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a record's spans, and pages before and after them."""
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    length = F.col("end") - F.col("start") + 1
    return S.tile(gold(paged), sizes).join(sizes, "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("spans"), F.round(F.avg(length), 9).alias("mean_pages"), F.percentile(length, F.lit(0.5)).alias("median_pages"),
        F.max(length).alias("most_pages"), F.round(F.avg((F.col("end") == F.col("start")).cast("double")), 9).alias("single_share"),
        (F.min("start") - 1).alias("front_gap"), (F.max("n") - F.max("end")).alias("tail_gap"),
    )
