"""Queries on pages: assembly and cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import pages as P
from quirewise.operators import spans as S
from quirewise.registry import query
from quirewise.sources.tables import pages, start_pages, table

from .views import GOLD_SPANS, GOLD_STARTS, PAGES, SIZES, gold


@query(
    f"""WITH {PAGES} SELECT doc_id, count(*) AS n_pages, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, round(sum(strlen(text)) / 1048576.0, 9) AS size_mb,
string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS page_list FROM pages_v GROUP BY doc_id"""
)
def page_view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, bytes and page list of every document."""
    sized = P.page_sizes(pages(spark, sf_dir))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ",")
    return sized.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum("bytes").alias("n_bytes"), F.round(F.sum("bytes") / 1048576, 9).alias("size_mb"), listed.alias("page_list")
    )


_SPAN_PAGES = f"""{PAGES}, {SIZES}, {GOLD_STARTS}, {GOLD_SPANS},
sp AS (SELECT s.doc_id, s.start, p.page, p.text, length(p.text) % 7 <> 0 AS ok FROM gold_spans s JOIN pages_v p ON p.doc_id = s.doc_id AND p.page BETWEEN s.start AND s."end")"""


def _span_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = pages(spark, sf_dir)
    spans = S.tile(gold(paged), S.sizes_of(paged))
    return S.span_pages(spans).join(paged, ["doc_id", "page"]).withColumn("ok", F.length("text") % 7 != 0)


@query(
    f"""WITH {_SPAN_PAGES} SELECT doc_id, start, coalesce(string_agg('Page ' || (page + 100) || ':' || chr(10) || text, chr(10) ORDER BY page) FILTER (WHERE ok), '') AS text,
count(*) AS pages, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE NOT ok), '') AS errored,
coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE ok AND trim(text, ' ') = ''), '') AS blank FROM sp GROUP BY doc_id, start"""
)
def page_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked text of every span, with a report of failed and blank pages."""
    return P.assemble(_span_pages(spark, sf_dir), ["doc_id", "start"], True, 100)


@query(
    f"""WITH {_SPAN_PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY page) AS rn FROM sp),
k AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, start ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r WHERE rn <= 3 AND trim(text, ' ') <> '')
SELECT doc_id, start, left(string_agg(text, chr(10) ORDER BY page), 300) AS text FROM k WHERE before < 300 GROUP BY doc_id, start"""
)
def escalation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of every span, as far as they are needed."""
    return P.escalation_text(_span_pages(spark, sf_dir), ["doc_id", "start"], 3, 300)


COUNTED = """cp AS (SELECT doc_id, page, text || CASE WHEN length(text) % 3 = 0 THEN '' ELSE ' Page ' || (page % 4 + 1) || ' of ' || (3 + length(text) % 2) || ' copies' END AS text FROM pages_v)"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    mark = F.concat(F.lit(" Page "), (F.col("page") % 4 + 1).cast("string"), F.lit(" of "), (3 + n % 2).cast("string"), F.lit(" copies"))
    return pages(spark, sf_dir).withColumn("text", F.concat("text", F.when(n % 3 == 0, "").otherwise(mark)))


@query(
    f"""WITH {PAGES}, {COUNTED}, c AS (SELECT doc_id, page, TRY_CAST(regexp_extract(text, 'Page (\\d+) of (\\d+) copies$', 1) AS INT) AS x0,
  TRY_CAST(regexp_extract(text, 'Page (\\d+) of (\\d+) copies$', 2) AS INT) AS y0 FROM cp),
v AS (SELECT doc_id, page, CASE WHEN x0 <= y0 THEN x0 END AS x, CASE WHEN x0 <= y0 THEN y0 END AS y FROM c),
p AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS px, last_value(y IGNORE NULLS) OVER w AS py FROM v
  WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, page AS start FROM p WHERE page = 1 OR x IS NOT NULL AND CASE WHEN px IS NULL THEN x = 1 ELSE x = 1 OR x <= px OR y <> py END"""
)
def counter_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts where printed page counters restart."""
    return P.counter_starts(_counted(spark, sf_dir))


@query(
    f"""WITH {PAGES}, b AS (SELECT doc_id, page, lag(trim(text, ' ') = '' OR length(text) % 17 = 0) OVER (PARTITION BY doc_id ORDER BY page) AS b FROM pages_v)
SELECT doc_id, page AS start FROM b WHERE b"""
)
def blank_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts after blank separators."""
    blanked = pages(spark, sf_dir).withColumn("text", F.when(F.length("text") % 17 == 0, "").otherwise(F.col("text")))
    return P.after_blank(blanked)


@query()
def band_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts where the header and footer change."""
    return P.band_starts(pages(spark, sf_dir))


@query()
def transition_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of every page transition."""
    return P.transition_signals(_counted(spark, sf_dir))


_BLANK = "[ \\t\\n\\x0B\\f\\r]"
#: The first printed counter of a page, in all forms that count.
_COUNTER = rf"(?i)page{_BLANK}{{0,2}}([0-9]{{1,3}}){_BLANK}{{0,2}}(?:of|/){_BLANK}{{0,2}}([0-9]{{1,4}})"


@query(
    f"""WITH {PAGES}, {COUNTED}, c AS (SELECT doc_id, page, strlen(text) AS b, TRY_CAST(regexp_extract(text, '{_COUNTER}', 1) AS INT) AS x,
  TRY_CAST(regexp_extract(text, '{_COUNTER}', 2) AS INT) AS y FROM cp),
p AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY page) AS pb FROM c)
SELECT doc_id, page, CASE WHEN x >= 1 AND y >= x THEN CASE WHEN x = 1 THEN 1 ELSE -1 END ELSE 0 END AS pagenum,
CASE WHEN abs(b - pb) / greatest(b, pb, 1) >= 0.5 THEN 1 ELSE 0 END AS bytes FROM p WHERE page > 1"""
)
def transition_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of counters and sizes."""
    return P.transition_features(_counted(spark, sf_dir)).select("doc_id", "page", "pagenum", "bytes")


@query(
    """WITH r AS (SELECT user_id, event_id % 6 + 1 AS i, CASE WHEN event_id % 13 < 4 THEN event_id % 6 + 1 + user_id % 5 + CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END END AS printed, event_id FROM events),
c AS (SELECT user_id, printed - i AS off, count(*) AS n, min(i) AS f FROM r WHERE printed IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, off) AS rn FROM c)
SELECT u.user_id, CASE WHEN n >= 2 THEN off END AS "offset" FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN b ON b.user_id = u.user_id AND rn = 1"""
)
def counter_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page offset that most readings agree on."""
    i = F.col("event_id") % 6 + 1
    printed = i + F.col("user_id") % 5 + F.when(F.col("event_id") % 4 == 0, 3).otherwise(0)
    # Of some pages no number could be read.
    readings = table(spark, sf_dir, "events").select("user_id", i.alias("i"), F.when(F.col("event_id") % 13 < 4, printed).alias("printed"))
    return P.counter_offset(readings, "user_id", 6)


@query(
    """WITH f AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href="[^"]*?(?:page=|/p|#p)(\\d{1,6})', 1), lambda x: CAST(x AS INT)) AS n FROM pages),
u AS (SELECT page_id, unnest(list_distinct(n)) AS v, CASE WHEN list_contains(n, 0) THEN 1 ELSE 0 END AS shift FROM f) SELECT page_id, v + shift AS start FROM u"""
)
def index_start_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start pages from the link targets of web pages."""
    return start_pages(table(spark, sf_dir, "pages"))


@query(
    f"WITH {PAGES} SELECT doc_id, (page - 1) // 100 AS chunk, count(*) AS n_pages, min(page) AS first_page FROM pages_v GROUP BY ALL"
)
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by files of a hundred."""
    chunk = F.floor((F.col("page") - 1) / 100)
    return pages(spark, sf_dir).groupBy("doc_id", chunk.alias("chunk")).agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"))
