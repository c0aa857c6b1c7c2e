"""Queries of the span algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.sources.tables import pages, table

from .views import GOLD_SPANS, GOLD_STARTS, PAGES, PRED_STARTS, SIZES, TURNS, gold, predicted, turn_view

OVERLAP, BUDGET, MOST = 2, 1200, 8

_WINDOWS = f"""
{PAGES}, b AS (SELECT doc_id, page, strlen(text) AS bytes FROM pages_v),
p AS MATERIALIZED (SELECT doc_id, page, bytes, CAST(sum(bytes) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS upto,
  max(page) OVER (PARTITION BY doc_id) AS n, max(bytes) OVER (PARTITION BY doc_id) AS top FROM b),
e AS MATERIALIZED (SELECT s.doc_id, s.page AS s, max(x.page) AS e, any_value(s.n) AS n FROM p s JOIN p x ON x.doc_id = s.doc_id
  AND x.page BETWEEN s.page AND s.page + {MOST - 1} AND x.upto - s.upto + s.bytes <= {BUDGET}
  WHERE s.top <= {BUDGET} GROUP BY s.doc_id, s.page),
w(doc_id, k, s, e, n) AS (SELECT doc_id, 0, s, e, n FROM e WHERE s = 1
  UNION ALL SELECT e.doc_id, w.k + 1, e.s, e.e, e.n FROM w JOIN e ON e.doc_id = w.doc_id AND w.e < w.n
  AND e.s = greatest(w.s + 1, w.e - least({OVERLAP}, greatest(1, (w.e - w.s + 1) // 3)) + 1))"""


@query(
    f"WITH RECURSIVE {_WINDOWS} SELECT doc_id, k, s AS start, e AS \"end\" FROM w "
    f"UNION ALL SELECT DISTINCT doc_id, -1, NULL, NULL FROM p WHERE top > {BUDGET}"
)
def budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of every document under a budget of bytes and pages."""
    sized = pages(spark, sf_dir).select("doc_id", "page", F.octet_length("text").alias("bytes"))
    return S.budget_windows(sized, OVERLAP, BUDGET, MOST)


@query(
    f"WITH {PAGES}, {SIZES}, g AS (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM sizes), "
    "f AS (SELECT *, min(CASE WHEN s + 5 >= n THEN s END) OVER (PARTITION BY doc_id) AS last FROM g) "
    'SELECT doc_id, (s - 1) // 4 AS k, s AS start, least(s + 5, n) AS "end" FROM f WHERE s <= last'
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six pages that share two."""
    return S.fixed_windows(S.sizes_of(pages(spark, sf_dir)), 6, 2)


@query(
    f"WITH {PAGES}, {SIZES} SELECT doc_id, (s - 1) // 10 AS k, s AS start, least(s + 9, n) AS \"end\" "
    "FROM (SELECT doc_id, n, unnest(range(1, n + 1, 10)) AS s FROM sizes)"
)
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten pages."""
    return S.chunk_grid(S.sizes_of(pages(spark, sf_dir)), 10)


@query(f"WITH {PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS} SELECT * FROM gold_spans")
def tiled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that tile every document, from its start pages."""
    paged = pages(spark, sf_dir)
    return S.tile(gold(paged), S.sizes_of(paged))


_FIXED = """f0 AS (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM sizes),
f1 AS (SELECT *, min(CASE WHEN s + 5 >= n THEN s END) OVER (PARTITION BY doc_id) AS last FROM f0),
win AS (SELECT doc_id, (s - 1) // 4 AS k, s AS ws, least(s + 5, n) AS we, n FROM f1 WHERE s <= last),
rep AS (SELECT w.doc_id, w.k, g.start - w.ws AS pos, g.start, CAST(w.k AS VARCHAR) || ':' || g.start AS title
  FROM win w JOIN pred g ON g.doc_id = w.doc_id AND g.start BETWEEN w.ws AND w.we)"""


def _reports(paged: DataFrame, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports of fixed windows: each names the starts it sees, the predicted ones if no others are given."""
    sizes = S.sizes_of(paged)
    windows = S.fixed_windows(sizes, 6, 2)
    seen = S.span_pages(windows).select("doc_id", "k", F.col("start").alias("ws"), F.col("page").alias("start"))
    reports = seen.join(predicted(paged) if starts is None else starts, ["doc_id", "start"]).select(
        "doc_id",
        "k",
        (F.col("start") - F.col("ws")).alias("pos"),
        "start",
        F.concat_ws(":", F.col("k").cast("string"), F.col("start").cast("string")).alias("title"),
    )
    return reports, windows, sizes


@query(
    f"""WITH {PAGES}, {SIZES}, {PRED_STARTS}, {_FIXED},
own AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 0 ELSE ws END AS lo, coalesce(lead(ws) OVER (PARTITION BY doc_id ORDER BY k), n) AS hi FROM win),
kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id, start ORDER BY r.k, pos) AS rn FROM rep r JOIN own o ON o.doc_id = r.doc_id AND o.k = r.k
  WHERE start > lo AND start <= hi),
rows_v AS (SELECT doc_id, start, title, '' AS flag FROM kept WHERE rn = 1 UNION ALL
  SELECT doc_id, 1, '-', 'x' FROM sizes WHERE doc_id NOT IN (SELECT doc_id FROM kept WHERE start = 1))
SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end", title, flag FROM rows_v JOIN sizes USING (doc_id)"""
)
def ownership_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans merged from what overlapping windows report."""
    return S.ownership_merge(*_reports(pages(spark, sf_dir)))


@query(
    f"""WITH {PAGES}, {SIZES}, {PRED_STARTS}, {GOLD_STARTS}, {_FIXED},
t AS (SELECT doc_id, k, pos, start, title FROM rep WHERE k % 2 = 1 UNION ALL SELECT w.doc_id, w.k, g.start - w.ws, g.start, CAST(w.k AS VARCHAR) || ':' || g.start FROM win w JOIN gold g ON g.doc_id = w.doc_id AND g.start BETWEEN w.ws AND w.we WHERE w.k % 2 = 0)
SELECT t.* FROM t JOIN (SELECT doc_id, k, lag(we) OVER (PARTITION BY doc_id ORDER BY k) AS until FROM win) u USING (doc_id, k)
WHERE until IS NULL OR start > until OR EXISTS (SELECT 1 FROM t b WHERE b.doc_id = t.doc_id AND b.k = t.k - 1 AND abs(b.start - t.start) <= 2)"""
)
def overlap_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in overlaps that the window before confirms; every other window sees other starts."""
    paged = pages(spark, sf_dir)
    reports, windows, _ = _reports(paged)
    others, _, _ = _reports(paged, gold(paged))
    return S.overlap_vote(reports.where("k % 2 = 1").unionByName(others.where("k % 2 = 0")), windows)


@query(
    """WITH f AS (SELECT source, doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_pages FROM documents)
SELECT source, doc_id, n_pages, CAST(sum(n_pages) OVER w AS BIGINT) AS "end", CAST(sum(n_pages) OVER w AS BIGINT) - n_pages + 1 AS start
FROM f WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""
)
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of each source's documents put into one file."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("source", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_pages"))
    return S.running_ranges(files, "source", "doc_id")


_REFUTED = "lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role OR length(text) % 4 = 0"


@query(
    f"""WITH {TURNS}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR NOT coalesce({_REFUTED}, false) THEN 1 ELSE 0 END AS br FROM turns_v
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, CAST(sum(br) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM m)
SELECT conv_id, island, min(start) AS start, max("end") AS "end", min_by(title, turn) AS title, max(CASE WHEN flag = 'x' THEN 'x' ELSE '' END) AS flag,
count(*) AS n_rows FROM i GROUP BY conv_id, island"""
)
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns folded into the one before where the boundary is refuted."""
    rows = turn_view(spark, sf_dir)
    return S.fold_islands(rows, _refuted(), "conv_id", "turn")


def _refuted():
    from pyspark.sql import Window

    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    return (F.lag("role").over(by_turn) == F.col("role")) | (F.length("text") % 4 == 0)


@query(
    f"""WITH {TURNS} SELECT conv_id, turn, coalesce({_REFUTED}, false) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS suggest_merge
FROM turns_v"""
)
def merge_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose boundary is refuted, marked only."""
    marked = S.mark_suggestions(turn_view(spark, sf_dir), _refuted(), "conv_id", "turn")
    return marked.select("conv_id", "turn", "suggest_merge")


@query(
    f"""WITH {TURNS}, m AS (SELECT *, row_number() OVER w AS pos, coalesce((lag(category) OVER w = category AND lag(date) OVER w = date AND date <> '-')
  OR "end" - start < 2, false) AS triggered FROM turns_v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY triggered DESC, turn) AS rk FROM m WHERE pos > 1)
SELECT conv_id, turn, triggered FROM r WHERE rk <= 3"""
)
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three boundaries of each conversation to look at again."""
    return S.suspects(turn_view(spark, sf_dir), 3, "conv_id", "turn").select("conv_id", "turn", "triggered")


@query(
    f"""WITH {PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS} SELECT s.doc_id, s.start, count(*) AS n_pages, CAST(sum(strlen(p.text)) AS BIGINT) AS n_bytes
FROM gold_spans s JOIN pages_v p ON p.doc_id = s.doc_id AND p.page BETWEEN s.start AND s."end" GROUP BY ALL"""
)
def span_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans joined to their pages, by explosion and not by range comparison."""
    return _span_sums(spark, sf_dir, 0)


@query(
    f"""WITH {PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS} SELECT s.doc_id, s.start, count(*) AS n_pages, CAST(sum(strlen(p.text)) AS BIGINT) AS n_bytes
FROM gold_spans s JOIN pages_v p ON p.doc_id = s.doc_id AND p.page BETWEEN s.start - 2 AND s."end" + 2 GROUP BY ALL"""
)
def span_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans joined to their pages and two on either side."""
    return _span_sums(spark, sf_dir, 2)


def _span_sums(spark: SparkSession, sf_dir: str, margin: int) -> DataFrame:
    paged = pages(spark, sf_dir)
    spans = S.tile(gold(paged), S.sizes_of(paged))
    joined = S.span_pages(spans, margin).join(paged, ["doc_id", "page"])
    return joined.groupBy("doc_id", "start").agg(F.count("*").alias("n_pages"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query(
    f"""WITH {TURNS}, c AS (SELECT *, CASE WHEN length(text) % 3 = 0 THEN start + 1 + length(text) % 5 END AS cut FROM turns_v),
h AS (SELECT conv_id, turn, start, CASE WHEN cut > start AND cut <= "end" THEN cut - 1 ELSE "end" END AS "end", title, flag FROM c UNION ALL
  SELECT conv_id, turn, cut, "end", '-', 'x' FROM c WHERE cut > start AND cut <= "end") SELECT * FROM h"""
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut in two at a page inside them."""
    rows = turn_view(spark, sf_dir)
    cut = F.when(F.length("text") % 3 == 0, F.col("start") + 1 + F.length("text") % 5)
    return S.split_at(rows.select("conv_id", "turn", "start", "end", "title", "flag", "text"), cut).drop("text")


@query(
    f"""WITH {PAGES}, {SIZES}, x AS (SELECT doc_id, page AS start, least(page + length(text) % 4, n) AS "end" FROM pages_v JOIN sizes USING (doc_id)
  WHERE length(text) % 3 = 0),
t AS (SELECT doc_id, unnest(range(start, "end" + 1)) AS page FROM x), c AS (SELECT doc_id, page, count(*) AS k FROM t GROUP BY ALL)
SELECT p.doc_id, count(*) FILTER (WHERE k IS NULL) AS gaps, count(*) FILTER (WHERE k > 1) AS overlaps FROM pages_v p LEFT JOIN c USING (doc_id, page) GROUP BY 1"""
)
def partition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that loose spans leave out or cover twice."""
    paged = pages(spark, sf_dir)
    sizes = S.sizes_of(paged)
    loose = paged.where(F.length("text") % 3 == 0).join(sizes, "doc_id").select(
        "doc_id", F.col("page").alias("start"), F.least(F.col("page") + F.length("text") % 4, F.col("n")).alias("end")
    )
    return S.coverage(loose, sizes)


