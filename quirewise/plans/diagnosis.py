"""Queries that say where a segmentation fails, and of the segmentation itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import diagnose as G
from quirewise.operators import pages as P
from quirewise.operators import segmentation as M
from quirewise.operators import spans as S
from quirewise.operators.graph import checkpoint
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .spans import _WINDOWS, BUDGET, MOST, OVERLAP
from .views import GOLD_SPANS, GOLD_STARTS, PAGES, PRED_SPANS, PRED_STARTS, SIZES, gold, predicted, predicted_all

SEAM = 12
SEAMS = f"seams AS (SELECT doc_id, unnest(range(1 + {SEAM}, n + 1, {SEAM})) AS start FROM sizes)"
BASE = f"{PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS}, {PRED_STARTS}, {PRED_SPANS}"
#: True spans that leave some pages out, as truth is no partition.
HOLED = 'holed AS (SELECT * FROM gold_spans WHERE (start + "end") % 7 <> 0)'
ERRORS = f"""{BASE}, {SEAMS}, {HOLED}, fs AS (SELECT doc_id, start FROM pred_all EXCEPT SELECT doc_id, start FROM gold),
ms AS (SELECT doc_id, start FROM gold EXCEPT SELECT doc_id, start FROM pred_all),
errors AS (SELECT f.doc_id, f.start, CASE WHEN EXISTS (SELECT 1 FROM seams s WHERE s.doc_id = f.doc_id AND s.start = f.start) THEN 'seam'
  WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = f.doc_id AND abs(g.start - f.start) <= 2) THEN 'near'
  WHEN EXISTS (SELECT 1 FROM holed h WHERE h.doc_id = f.doc_id AND f.start BETWEEN h.start AND h."end") THEN 'over_split' ELSE 'unlabeled' END AS kind FROM fs f
UNION ALL SELECT m.doc_id, m.start, CASE WHEN EXISTS (SELECT 1 FROM pred_all p WHERE p.doc_id = m.doc_id AND abs(p.start - m.start) <= 2) THEN 'missed_near' ELSE 'missed_hard' END FROM ms m)"""


def _seams(sizes: DataFrame) -> DataFrame:
    return S.chunk_grid(sizes, SEAM).where("k > 0").select("doc_id", "start")


def _holed(paged: DataFrame, sizes: DataFrame) -> DataFrame:
    return S.tile(gold(paged), sizes).where("(start + end) % 7 <> 0")


def _errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    holed = _holed(paged, sizes)
    return G.start_errors(predicted_all(paged), gold(paged), holed, _seams(sizes)), holed


@query(f"WITH {ERRORS} SELECT * FROM errors")
def start_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wrong start of every document, with the kind of its error."""
    return _errors(spark, sf_dir)[0]


@query(
    f"""WITH {ERRORS}, c AS (SELECT h.doc_id, h.start, h."end", count(*) AS pieces FROM holed h JOIN errors e ON e.doc_id = h.doc_id AND e.kind = 'over_split' AND e.start BETWEEN h.start AND h."end" GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pieces DESC, start, "end") <= 5"""
)
def worst_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five true spans of each document that are cut most."""
    errors, holed = _errors(spark, sf_dir)
    return G.worst_split(errors, holed)


@query(f'WITH {BASE}, {SEAMS} SELECT * FROM gold_spans g WHERE EXISTS (SELECT 1 FROM seams s WHERE s.doc_id = g.doc_id AND g.start < s.start AND s.start <= g."end")')
def severed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True spans that a chunk's edge cuts."""
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    return G.severed(S.tile(gold(paged), sizes), _seams(sizes))


_CHUNKED = f"""{BASE}, ck AS (SELECT doc_id, (s - 1) // {SEAM} AS k, s AS first, least(s + {SEAM - 1}, n) AS last FROM (SELECT doc_id, n, unnest(range(1, n + 1, {SEAM})) AS s FROM sizes)),
cr AS (SELECT p.doc_id, k, p.start, least(p."end" + length(t.text) % 3 - 1, last) AS "end" FROM pred_spans p JOIN pages_v t ON t.doc_id = p.doc_id AND t.page = p.start JOIN ck ON ck.doc_id = p.doc_id AND p.start BETWEEN first AND last
  WHERE least(p."end" + length(t.text) % 3 - 1, last) >= p.start)"""


@query(
    f"""WITH {_CHUNKED}, w AS (SELECT *, greatest(first, coalesce(max("end") OVER (PARTITION BY doc_id, k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, first)) AS a0 FROM cr JOIN ck USING (doc_id, k)),
g AS (SELECT doc_id, k, sum(greatest(start - a0, 0)) AS g, sum(greatest(a0 - start, 0)) AS o, max("end") AS e FROM w GROUP BY doc_id, k)
SELECT doc_id, k, CAST(coalesce(g, 0) + greatest(last - greatest(coalesce(e, first - 1), first - 1), 0) AS BIGINT) AS gaps, CAST(coalesce(o, 0) AS BIGINT) AS overlaps FROM ck LEFT JOIN g USING (doc_id, k)"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the rows of each chunk leave out or repeat."""
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    chunks = S.chunk_grid(sizes, SEAM).select("doc_id", "k", F.col("start").alias("first"), F.col("end").alias("last"))
    placed = S.tile(predicted_all(paged), sizes).withColumn("k", F.floor((F.col("start") - 1) / SEAM).cast("int"))
    lengths = paged.select("doc_id", F.col("page").alias("start"), (F.length("text") % 3 - 1).alias("off"))
    rows = placed.join(lengths, ["doc_id", "start"]).join(chunks, ["doc_id", "k"])
    moved = rows.select("doc_id", "k", "start", F.least(F.col("end") + F.col("off"), F.col("last")).alias("end")).where("end >= start")
    return G.chunk_coverage(moved, chunks)


@query(
    f"""WITH {BASE}, kept AS (SELECT pred_all.doc_id, start FROM pred_all JOIN pages_v ON pages_v.doc_id = pred_all.doc_id AND page = start WHERE start = 1 OR length(text) % 2 = 0)
SELECT doc_id, start FROM gold INTERSECT SELECT doc_id, start FROM pred_all EXCEPT SELECT doc_id, start FROM kept"""
)
def harmed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True starts that merging away every second row loses."""
    paged = pages(spark, sf_dir)
    before = predicted_all(paged)
    kept = before.join(paged.select("doc_id", F.col("page").alias("start"), F.length("text").alias("n")), ["doc_id", "start"]).where("start = 1 OR n % 2 = 0")
    return G.harmed(gold(paged), before, kept)


@query(
    f"""WITH {PAGES}, b AS (SELECT doc_id, page, text, lag(trim(text, ' ') = '') OVER (PARTITION BY doc_id ORDER BY page) AS after FROM pages_v)
SELECT doc_id, page AS start FROM b WHERE after UNION SELECT doc_id, page FROM pages_v WHERE page = 1 OR length(text) % 13 = 0"""
)
def cue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts after blank pages, or by the form of the page."""
    paged = pages(spark, sf_dir)
    form = paged.where((F.col("page") == 1) | (F.length("text") % 13 == 0)).select("doc_id", F.col("page").alias("start"))
    return G.union_of([P.after_blank(paged), form])


@query(
    f"""WITH {BASE}, ev AS (SELECT DISTINCT doc_id, start + doc_id % 3 AS start FROM gold WHERE start % 4 <> 0),
h AS (SELECT g.doc_id, k, count(e.start) AS n FROM gold g CROSS JOIN range(-10, 11) r(k) LEFT JOIN ev e ON e.doc_id = g.doc_id AND e.start = g.start + k GROUP BY g.doc_id, k),
b AS (SELECT doc_id, max(n) FILTER (WHERE k = 0) AS hits, arg_max(CASE WHEN n > 0 THEN k ELSE 0 END, [n, -abs(k), -k]) AS shift, max(n) AS best FROM h GROUP BY doc_id)
SELECT doc_id, hits, shift, best, CASE WHEN shift <> 0 AND best >= greatest(hits + 3, CAST(floor(greatest(hits, 1) * 1.5) AS BIGINT)) THEN 'offset' WHEN best = 0 THEN 'inconclusive' ELSE 'aligned' END AS verdict FROM b"""
)
def offset_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the evidence of printed numbers says that a document's truth is shifted."""
    truth = gold(pages(spark, sf_dir))
    evidence = truth.where("start % 4 <> 0").select("doc_id", (F.col("start") + F.col("doc_id") % 3).alias("start"))
    return G.offset_verdict(truth, evidence)


@query(
    f"""WITH {BASE}, s AS (SELECT p.doc_id, p.start FROM pred_all p JOIN pages_v t ON t.doc_id = p.doc_id AND t.page = p.start WHERE p.start > 1 AND length(text) % 2 = 1),
m AS (SELECT doc_id, start, bool_or(w = 's') AS s, bool_or(w = 'r') AS r, bool_or(w = 't') AS t FROM (SELECT doc_id, start, 's' AS w FROM s UNION ALL SELECT doc_id, start, 'r' FROM pred_all UNION ALL SELECT doc_id, start, 't' FROM gold) GROUP BY doc_id, start),
c AS (SELECT doc_id, count(*) FILTER (WHERE s) AS suggestions, count(*) FILTER (WHERE s AND NOT t) AS correct, count(*) FILTER (WHERE r AND NOT t AND start <> 1) AS o FROM m GROUP BY doc_id)
SELECT doc_id, suggestions, correct, round(coalesce(correct / nullif(suggestions, 0), 0), 9) AS precision, round(coalesce(correct / nullif(o, 0), 0), 9) AS coverage FROM c"""
)
def suggestion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good suggested merges are, by document."""
    paged = pages(spark, sf_dir)
    rows = predicted_all(paged)
    lengths = paged.select("doc_id", F.col("page").alias("start"), F.length("text").alias("n"))
    suggested = rows.join(lengths, ["doc_id", "start"]).where("start > 1 AND n % 2 = 1")
    scored = G.suggestion_scores(suggested, rows, gold(paged))
    return scored.withColumns({c: F.round(c, 9) for c in ("precision", "coverage")})


@query(
    f"""WITH {PAGES}, l AS (SELECT lang, length(p.text) AS n FROM pages_v p JOIN documents USING (doc_id) WHERE page > 1),
v AS (SELECT lang, n % 5 = 0 AS t, CASE WHEN n % 11 = 3 THEN NULL ELSE n % 15 < 4 END AS a FROM l)"""
    """, c AS (SELECT lang, CAST(count(*) FILTER (WHERE t AND a) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT t AND a) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE t AND NOT coalesce(a, false)) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE NOT t AND NOT coalesce(a, false)) AS DOUBLE) AS tn, count(*) FILTER (WHERE a IS NULL) AS nulls, count(*) AS asked FROM v GROUP BY lang)
SELECT lang, nulls, asked, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9) AS mcc,
round(((tp + tn) / asked - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (asked * asked)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (asked * asked)), 9) AS kappa,
round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy FROM c"""
)
def oracle_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the answers of a page oracle are to be trusted, by language."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = F.length("text")
    answer = F.when(n % 11 == 3, None).otherwise(F.when(n % 15 < 4, "NEW").otherwise("SAME"))
    asked = pages(spark, sf_dir).where("page > 1").join(langs, "doc_id").select("lang", (n % 5 == 0).alias("truth"), answer.alias("answer"))
    scored = G.oracle_reliability(asked, "NEW", ["lang"])
    return scored.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "mcc", "kappa", "balanced_accuracy")})


_SCORED = f"""{BASE}, pg AS (SELECT v.doc_id, page, n, g.start IS NOT NULL AS r, p.start IS NOT NULL AS h FROM pages_v v JOIN sizes USING (doc_id) LEFT JOIN gold g ON g.doc_id = v.doc_id AND g.start = page LEFT JOIN pred_all p ON p.doc_id = v.doc_id AND p.start = page),
cf AS (SELECT doc_id, CAST(count(*) FILTER (WHERE r AND h) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT r AND h) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE r AND NOT h) AS DOUBLE) AS fn FROM pg GROUP BY doc_id),
sb AS (SELECT doc_id, count(*) AS b, sum("end" - start + 1) AS wb FROM (SELECT * FROM gold_spans INTERSECT SELECT * FROM pred_spans) GROUP BY doc_id),
sg AS (SELECT doc_id, count(*) AS g, sum("end" - start + 1) AS wg FROM gold_spans GROUP BY doc_id), sp AS (SELECT doc_id, count(*) AS p, sum("end" - start + 1) AS wp FROM pred_spans GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) OVER w AS m, sum(CASE WHEN r AND page > 1 THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN h AND page > 1 THEN 1 ELSE 0 END) OVER w AS b FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
wd AS (SELECT doc_id, avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) AS windowdiff, avg(CASE WHEN (a > 0) <> (b > 0) THEN 1.0 ELSE 0.0 END) AS pk FROM ws WHERE m = 3 GROUP BY doc_id),
os AS (SELECT doc_id, avg(d) AS o FROM (SELECT g.doc_id, g.start, min(abs(p.start - g.start)) AS d FROM gold g JOIN pred_all p USING (doc_id) GROUP BY ALL) GROUP BY doc_id)"""


@query(
    f"""WITH {_SCORED} SELECT doc_id, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
round(coalesce(2.0 * b / (p + g), 0), 9) AS exact_f1, round(coalesce(2.0 * wb / (wp + wg), 0), 9) AS weighted_f1, round(p / g, 9) AS over_segmentation, round(windowdiff, 9) AS windowdiff, round(pk, 9) AS pk, round(o, 9) AS "offset"
FROM cf JOIN sg USING (doc_id) JOIN sp USING (doc_id) LEFT JOIN sb USING (doc_id) LEFT JOIN wd USING (doc_id) LEFT JOIN os USING (doc_id)"""
)
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every document's segmentation in one row."""
    paged = pages(spark, sf_dir)
    scored = G.scores_of(predicted_all(paged), gold(paged), S.sizes_of(paged), 3)
    names = ("precision", "recall", "exact_f1", "weighted_f1", "over_segmentation", "windowdiff", "pk", "offset")
    return scored.select("doc_id", *[F.round(c, 9).alias(c) for c in names])


@query(
    """WITH v AS (SELECT o_custkey AS record, o_orderkey % 97 AS score, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS label FROM orders),
t AS (SELECT record, score, sum(label) AS p, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT record, sum(p) OVER w AS hits, sum(n) OVER w AS flagged, sum(p) OVER (PARTITION BY record) AS al FROM t WINDOW w AS (PARTITION BY record ORDER BY score DESC)),
f AS (SELECT record, min(flagged) FILTER (WHERE hits >= greatest(1, al // 2)) AS a, max(flagged) AS z FROM r GROUP BY record)
SELECT r.record, CAST(hits AS BIGINT) AS hits, CAST(flagged AS BIGINT) AS flagged, round(hits / flagged, 9) AS precision FROM r JOIN f ON f.record = r.record AND r.flagged = coalesce(a, z)"""
)
def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision when half of each record's positives are found."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("record"), (F.col("o_orderkey") % 97).alias("score"), (F.col("o_orderstatus") == "O").cast("int").alias("label"))
    return G.precision_at_recall(rows).withColumn("precision", F.round("precision", 9))


@query(
    """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, n_chars FROM documents), f AS (SELECT doc_id FROM d QUALIFY row_number() OVER (PARTITION BY digest ORDER BY n_chars, doc_id) = 1)
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM f)"""
)
def one_copy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one document of every distinct text."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return G.one_copy_rows(docs.select("doc_id", "source"), files, "digest", ["n_chars"])


@query(
    """WITH h AS (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS b FROM documents),
l AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM h) SELECT doc_id, CAST(bit_count(xor(b, p)) AS INTEGER) AS bits FROM l WHERE p IS NOT NULL"""
)
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing bits of the hashes of neighbouring documents."""
    from pyspark.sql import Window

    b = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", b.alias("b"))
    before = F.lag("b").over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.withColumn("p", before).where("p IS NOT NULL").select("doc_id", G.hamming(F.col("b"), F.col("p")).alias("bits"))


@query(
    f"""WITH RECURSIVE {PAGES}, b AS (SELECT doc_id, page, strlen(text) AS bytes FROM pages_v),
p AS MATERIALIZED (SELECT doc_id, page, bytes, CAST(sum(bytes) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS upto, max(page) OVER (PARTITION BY doc_id) AS n, max(bytes) OVER (PARTITION BY doc_id) AS top FROM b),
e AS MATERIALIZED (SELECT s.doc_id, s.page AS s, max(x.page) AS e, any_value(s.n) AS n FROM p s JOIN p x ON x.doc_id = s.doc_id AND x.page >= s.page AND x.upto - s.upto + s.bytes <= {BUDGET} WHERE s.top <= {BUDGET} GROUP BY s.doc_id, s.page),
w(doc_id, k, s, e, n) AS (SELECT doc_id, 0, s, e, n FROM e WHERE s = 1 UNION ALL SELECT e.doc_id, w.k + 1, e.s, e.e, e.n FROM w JOIN e ON e.doc_id = w.doc_id AND w.e < w.n AND e.s = w.e + 1)
SELECT doc_id, k, s AS start, e AS "end" FROM w UNION ALL SELECT DISTINCT doc_id, -1, NULL, NULL FROM p WHERE top > {BUDGET}"""
)
def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks under a budget of bytes that do not overlap."""
    sized = pages(spark, sf_dir).select("doc_id", "page", F.octet_length("text").alias("bytes"))
    return S.budget_windows(sized, 0, BUDGET, 1 << 30)


@query(
    f"""WITH RECURSIVE {_WINDOWS}, pred AS (SELECT doc_id, page AS start FROM pages_v WHERE length(text) % 5 = 0 AND length(text) % 4 <> 0 OR length(text) % 13 = 0),
win AS MATERIALIZED (SELECT doc_id, k, s AS ws, e AS we, n FROM w), sizes AS (SELECT doc_id, max(we) AS n FROM win GROUP BY doc_id),
rep AS (SELECT w.doc_id, w.k, g.start - w.ws AS pos, g.start, CAST(w.k AS VARCHAR) || ':' || g.start AS title FROM win w JOIN pred g ON g.doc_id = w.doc_id AND g.start BETWEEN w.ws AND w.we),
own AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 0 ELSE ws END AS lo, coalesce(lead(ws) OVER (PARTITION BY doc_id ORDER BY k), n) AS hi FROM win),
kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id, start ORDER BY r.k, pos) AS rn FROM rep r JOIN own o ON o.doc_id = r.doc_id AND o.k = r.k WHERE start > lo AND start <= hi),
rows_v AS (SELECT doc_id, start, title, '' AS flag FROM kept WHERE rn = 1 UNION ALL SELECT doc_id, 1, '-', 'x' FROM sizes WHERE doc_id NOT IN (SELECT doc_id FROM kept WHERE start = 1)),
tiled AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end", title, flag FROM rows_v JOIN sizes USING (doc_id)),
cat AS (SELECT *, CASE WHEN start % 6 = 0 THEN '100' ELSE CAST(start % 3 AS VARCHAR) END AS category, CASE WHEN start % 6 = 0 THEN 'x' ELSE flag END AS fl FROM tiled),
sus AS (SELECT *, row_number() OVER w1 AS a0, lag(category) OVER w1 = category AS same_c, coalesce("end" - start < 2, false) AS tr FROM cat WINDOW w1 AS (PARTITION BY doc_id ORDER BY start)),
rk AS (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY tr DESC, start) AS r FROM sus WHERE a0 > 1),
jd AS (SELECT s.*, coalesce(r <= 3 AND (s.start + s.doc_id) % 4 = 0, false) AS same FROM sus s LEFT JOIN rk USING (doc_id, start)),
isl AS (SELECT *, sum(CASE WHEN a0 = 1 OR NOT same THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM jd)
SELECT doc_id, min(start) AS start, max("end") AS "end", arg_min(title, start) AS title, arg_min(category, start) AS category, max(CASE WHEN fl = 'x' THEN 'x' ELSE '' END) AS flag,
CASE WHEN min(start) % 2 = 0 THEN 'd' || max("end") ELSE '-' END AS injury_date, count(*) AS n_rows FROM isl GROUP BY doc_id, island"""
)
def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole segmentation of every document, with tables of verdicts in place of the models."""
    paged = pages(spark, sf_dir)
    sized = paged.select("doc_id", "page", F.octet_length("text").alias("bytes"))
    windows = checkpoint(S.budget_windows(sized, OVERLAP, BUDGET, MOST).where("k >= 0"))
    seen = S.span_pages(windows).select("doc_id", "k", F.col("start").alias("ws"), F.col("page").alias("start"))
    reports = seen.join(predicted(paged), ["doc_id", "start"]).select(
        "doc_id", "k", (F.col("start") - F.col("ws")).alias("pos"), "start", F.concat_ws(":", F.col("k").cast("string"), F.col("start").cast("string")).alias("title")
    )
    # Verdicts for every page and every span a record could have are rules on the pages here.
    spans = S.ownership_merge(reports, windows, windows.groupBy("doc_id").agg(F.max("end").alias("n")))
    votes = spans.where("start % 6 <> 0").select("doc_id", "start", "end", (F.col("start") % 3).cast("string").alias("category"))
    starts = paged.select("doc_id", F.col("page").alias("start"))
    continues = starts.withColumn("same", (F.col("start") + F.col("doc_id")) % 4 == 0)
    first = checkpoint(M.segment(windows, reports, votes, continues, 3))
    injuries = first.where("start % 2 = 0").select("doc_id", "start", "end", F.concat(F.lit("d"), F.col("end").cast("string")).alias("injury_date"))
    return M.with_injuries(first, injuries)
