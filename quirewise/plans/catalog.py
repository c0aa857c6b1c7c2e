"""Queries of the category catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import catalog as C
from quirewise.operators.order import ranked
from quirewise.registry import query
from quirewise.sources.tables import table

#: Parts stand for categories: as many as the table has.
CATALOG = """cat AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size % 4 <> 0 AS active, p_size % 3 <> 0 AS auto_assign, p_size % 5 <> 0 AS sm FROM part)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        (size % 4 != 0).alias("active"), (size % 3 != 0).alias("auto_assign"), (size % 5 != 0).alias("summarize"),
    )


@query(f"WITH {CATALOG} SELECT id, name, row_number() OVER (ORDER BY CAST(id AS INTEGER)) AS place FROM cat WHERE active AND auto_assign")
def category_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignable categories in the order of their numbers."""
    stored = _catalog(spark, sf_dir)
    kept = C.categories(stored, stored.limit(0), auto_assign=True).select("id", "name", F.col("id").cast("int").alias("_no"))
    return ranked(kept, "_no", "place").drop("_no")


@query("SELECT 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0")
def category_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active categories of the built-in catalog where none is stored."""
    built = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"),
        (F.col("c_acctbal") > 0).alias("active"), F.lit(True).alias("auto_assign"), F.lit(True).alias("summarize"),
    )
    return C.categories(_catalog(spark, sf_dir).where("id IS NULL"), built, active_only=True).select("id", "name")


@query(f"WITH {CATALOG} SELECT o_orderkey, coalesce(sm, true) AS include FROM orders LEFT JOIN cat ON id = CAST(o_orderkey % 300 AS VARCHAR)")
def include_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order is summarised by default; unknown categories are."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 300).cast("string").alias("category"))
    return C.include_default(rows, _catalog(spark, sf_dir)).select("o_orderkey", "include")


@query(
    """WITH e AS (SELECT DISTINCT p_brand, p_type FROM part), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, p_brand || '. ' || n || ' parts Examples: ' || string_agg(p_type, '; ' ORDER BY p_type) AS corpus FROM e JOIN n USING (p_brand) GROUP BY p_brand, n"""
)
def category_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each brand where texts are compared."""
    grouped = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("examples"), F.count("*").alias("n"))
    described = F.concat(F.col("n").cast("string"), F.lit(" parts"))
    return grouped.select("p_brand", C.corpus_text(F.col("p_brand"), described, F.col("examples")).alias("corpus"))


@query(
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 20 WHEN 0 THEN NULL WHEN 16 THEN '100' ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS c FROM orders),
f AS (SELECT o_orderkey, coalesce(c, '') AS c, coalesce(c, '') NOT IN ('1','2','5','6','12','13','3','14','9','4','7','8','10','11','15','100') AS u FROM o)
SELECT o_orderkey, 'F,C,S,' || CASE WHEN u OR c IN ('1','2','5','6','12','13') THEN 'N,' ELSE '' END || CASE WHEN u OR c IN ('3','14') THEN 'V,' ELSE '' END || CASE WHEN u OR c IN ('12','13') THEN 'E,' ELSE '' END
|| 'K,' || CASE WHEN u OR c IN ('1','2','5','6','12','13') THEN 'T,P,R,' ELSE '' END || 'H,' || CASE WHEN c = '9' THEN 'D,' ELSE 'O,' END || 'B,X,' AS preamble FROM f"""
)
def preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule blocks of every order's category, a letter for each."""
    texts = {
        "factuality": "F,", "content": "C,", "scope": "S,", "normal_findings": "N,", "verdict": "V,", "embedded_review": "E,", "codes": "K,", "vitals": "T,",
        "pain": "P,", "range_of_motion": "R,", "format": "H,", "deposition": "D,", "one_paragraph": "O,", "bold": "B,", "sentence_case": "X,",
    }
    no = F.col("o_orderkey") % 20
    id_ = F.when(no == 0, None).when(no == 16, "100").otherwise(no.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.preamble(id_, texts).alias("preamble"))


_CHANGES = f"""{CATALOG}, rw AS (SELECT l_orderkey AS doc_id, l_linenumber AS start, l_linenumber AS "end", CAST(l_partkey % 100 AS VARCHAR) AS was FROM lineitem WHERE l_linenumber % 4 <> 0),
rq AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_linenumber AS start, l_linenumber AS "end", CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 100 ELSE l_suppkey % 120 END AS VARCHAR) AS category FROM lineitem),
ch AS (SELECT rq.*, was, CASE WHEN o_orderstatus = 'P' THEN 'busy' WHEN cat.id IS NULL THEN 'unknown' WHEN was IS NULL THEN 'moved' WHEN was = category THEN 'same' ELSE 'changed' END AS outcome
FROM rq JOIN orders ON o_orderkey = doc_id LEFT JOIN cat ON cat.id = category AND cat.active LEFT JOIN rw USING (doc_id, start, "end"))"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    span = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end")]
    rows = lines.where("l_linenumber % 4 <> 0").select(*span, (F.col("l_partkey") % 100).cast("string").alias("category"))
    asked = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 100).otherwise(F.col("l_suppkey") % 120).cast("string")
    requests = lines.select(*span, F.col("l_linenumber").alias("idx"), asked.alias("category"))
    busy = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return C.category_changes(requests, rows, busy, _catalog(spark, sf_dir)), rows


@query(
    f"""WITH {_CHANGES} SELECT doc_id, idx, category, outcome, CASE WHEN outcome = 'changed' THEN 'idx ' || idx || ' pages ' || start || '-' || "end" || ': ' || was || ' -> ' || category END AS detail FROM ch"""
)
def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each wanted change of a row's category, and what the audit says."""
    return _changes(spark, sf_dir)[0].select("doc_id", "idx", "category", "outcome", "detail")


@query(
    f"""WITH {_CHANGES} SELECT rw.doc_id, rw.start, coalesce(c.category, rw.was) AS category FROM rw LEFT JOIN (SELECT doc_id, start, arg_max(category, [lpad(CAST(idx AS VARCHAR), 9, '0'), category]) AS category FROM ch WHERE outcome = 'changed' GROUP BY doc_id, start) c USING (doc_id, start)"""
)
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the accepted changes of category made."""
    changes, rows = _changes(spark, sf_dir)
    return C.with_changes(rows, changes).select("doc_id", "start", "category")


@query(
    """WITH n AS (SELECT user_id, event_type, event_type = 'error' OR value < 20 AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_type, max(r) AS revision, NOT coalesce(arg_max(deleted, r), false) AS active FROM n GROUP BY ALL"""
)
def catalog_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision and state of every category of every catalog after its edits."""
    gone = (F.col("event_type") == "error") | (F.col("value") < 20)
    edits = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", gone.alias("deleted"))
    return C.revisions(edits, "user_id", "event_type", ["ts", "event_id"])
