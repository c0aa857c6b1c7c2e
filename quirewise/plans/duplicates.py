"""Queries of near-duplicate detection and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import dedup as U
from quirewise.operators.order import ranked
from quirewise.registry import query
from quirewise.sources.tables import table

SIGNED = """sg AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '\\b\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{2,4}\\b', 'DATEMASK', 'g')), '[a-z0-9]{2,}'))) AS w FROM documents),
cl AS MATERIALIZED (SELECT doc_id, sha256(array_to_string(w, ' ')) AS sid, w FROM sg WHERE len(w) > 0),
st AS MATERIALIZED (SELECT sid, any_value(w) AS w, len(any_value(w)) AS n FROM cl GROUP BY sid),
tk AS MATERIALIZED (SELECT sid, n, unnest(w) AS t FROM st), df AS MATERIALIZED (SELECT t, count(*) AS f FROM tk GROUP BY t HAVING count(*) > 1),
px AS MATERIALIZED (SELECT * FROM (SELECT sid, n, t, row_number() OVER (PARTITION BY sid ORDER BY f, t) AS r FROM tk JOIN df USING (t)) WHERE r <= n - ceil(n * 0.7 - 1e-9) + 1),
cd AS MATERIALIZED (SELECT DISTINCT x.sid AS a, y.sid AS b FROM px x JOIN px y ON x.t = y.t AND x.sid < y.sid AND least(x.n, y.n) >= greatest(x.n, y.n) * 0.7 - 1e-9),
pr AS MATERIALIZED (SELECT a, b, len(list_intersect(x.w, y.w)) / CAST(x.n + y.n - len(list_intersect(x.w, y.w)) AS DOUBLE) AS jaccard
  FROM cd JOIN st x ON x.sid = a JOIN st y ON y.sid = b WHERE len(list_intersect(x.w, y.w)) / CAST(x.n + y.n - len(list_intersect(x.w, y.w)) AS DOUBLE) >= 0.7)"""
CLUSTERED = f"""{SIGNED}, it AS MATERIALIZED (SELECT doc_id, sid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'd' || doc_id % 2 END AS d FROM cl),
nd AS MATERIALIZED (SELECT sid, d, min(doc_id) AS node FROM it GROUP BY ALL),
ed AS MATERIALIZED (SELECT DISTINCT u.node AS u, v.node AS v FROM (SELECT a, b FROM pr UNION ALL SELECT sid, sid FROM st) p JOIN nd u ON u.sid = p.a JOIN nd v ON v.sid = p.b AND u.d = v.d AND u.node <> v.node),
e2 AS MATERIALIZED (SELECT u, v FROM ed UNION SELECT v, u FROM ed),
rc(node, c) AS (SELECT node, node FROM nd UNION SELECT e2.v, rc.c FROM rc JOIN e2 ON e2.u = rc.node WHERE rc.c < e2.v),
cc AS MATERIALIZED (SELECT node, min(c) AS cluster FROM rc GROUP BY node),
mm AS MATERIALIZED (SELECT it.doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM it JOIN nd USING (sid, d) JOIN cc USING (node)),
cm AS MATERIALIZED (SELECT doc_id, cluster FROM mm WHERE n >= 2)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "-").otherwise("N/A")).otherwise(
        F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", date.alias("date"))


@query(
    """SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) >= 2"""
)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and the copy that stays."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, sf_dir, "documents").groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("kept")).where("n >= 2")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn = 1")
def oldest_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each digest."""
    files = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return U.oldest_copy(files, "digest", "n_chars", "doc_id").select("doc_id", "digest")


@query(f"WITH {SIGNED} SELECT a, b, round(jaccard, 9) AS jaccard FROM pr")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different word sets with an overlap of 0.7."""
    classes = U.signature_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    sets = classes.groupBy("sid").agg(F.first("words").alias("words"))
    return U.jaccard_pairs(sets).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH RECURSIVE {CLUSTERED} SELECT * FROM cm")
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of near-duplicates of one date; unknown dates are one date."""
    return U.clusters(_items(spark, sf_dir), "doc_id")


@query()
def dup_clusters_cross_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters where texts alike to the character link across dates."""
    return U.clusters(_items(spark, sf_dir), "doc_id", cross_date=U.CROSS_DATE)


@query(
    """WITH m AS (SELECT o_custkey AS grp, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'd' || o_custkey % 3 END AS date, lower(o_orderstatus) AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'c' || o_custkey % 2 END AS category, CASE WHEN o_orderkey % 40 = 0 THEN 0.96 WHEN o_orderkey % 3 = 0 THEN 0.5 END AS s FROM orders),
g AS (SELECT grp, count(DISTINCT date) = 1 AND min(date) <> '' AS d, count(DISTINCT title) = 1 AND min(title) <> '' AS t, count(DISTINCT category) = 1 AND min(category) <> '' AS c, max(s) AS s FROM m GROUP BY grp)
SELECT grp, d AND (t OR c) OR coalesce(s >= 0.95, false) AS passes FROM g"""
)
def dup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that pass as duplicates."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    members = table(spark, sf_dir, "orders").select(
        c.alias("grp"),
        F.when(i % 5 == 0, " N/A ").otherwise(F.concat(F.lit("D"), (c % 3).cast("string"))).alias("date"),
        F.col("o_orderstatus").alias("title"),
        F.when(i % 7 == 0, "-").otherwise(F.concat(F.lit("C"), (c % 2).cast("string"))).alias("category"),
        F.when(i % 40 == 0, 0.96).when(i % 3 == 0, 0.5).alias("similarity"),
    )
    return U.gate(members, "grp")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey = min(o_orderkey) OVER w THEN bool_or(o_orderstatus = 'O') OVER w ELSE false END AS include FROM orders WINDOW w AS (PARTITION BY o_custkey)"""
)
def keep_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups resolved to their first row."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "O").alias("include"))
    first = F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    return U.keep_one(rows, "o_custkey", first).select("o_orderkey", "include")


@query(
    f"""WITH RECURSIVE {CLUSTERED}, f AS (SELECT DISTINCT cluster FROM cm) SELECT doc_id, dense_rank() OVER (ORDER BY cluster) AS grp FROM cm"""
)
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters numbered from 1 by their first row."""
    return U.number_groups(U.clusters(_items(spark, sf_dir), "doc_id"), "cluster", "doc_id").select("doc_id", "grp")


@query(
    """WITH a AS (SELECT l_orderkey AS grp, list_sort(list(DISTINCT l_linenumber * 100 + l_quantity // 1)) AS s FROM lineitem GROUP BY 1),
b AS (SELECT DISTINCT list_sort(list(DISTINCT l_linenumber * 100 + l_quantity // 1)) AS s FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey)
SELECT grp, b.s IS NOT NULL AS dismissed FROM a LEFT JOIN b ON a.s = b.s"""
)
def dismissed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that are exactly a set dismissed before."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("start"), F.floor("l_quantity").alias("end")
    )
    past = items.where("grp % 3 = 0").withColumnRenamed("grp", "past")
    return U.dismissed(items, past, "grp")


@query(
    """WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
br AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM bw WHERE len(w) >= 8)),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)),
t AS (SELECT item_id, count(*) AS n FROM br GROUP BY 1)
SELECT doc_id, item_id, round(count(*) / CAST(any_value(n) AS DOUBLE), 9) AS share FROM dr JOIN br USING (r) JOIN t USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / CAST(any_value(n) AS DOUBLE) >= 0.8"""
)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's passage."""
    docs, probes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return U.containment(docs.select("doc_id", "text"), probes).withColumn("share", F.round("share", 9))


_GROUPED = """m AS (SELECT o_custkey % 50 AS doc, o_custkey AS grp, o_orderkey AS id, o_orderstatus = 'O' AS include, o_orderkey % 11 = 0 AS dismissed FROM orders)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("doc"), F.col("o_custkey").alias("grp"), i.alias("id"),
        (F.col("o_orderstatus") == "O").alias("include"), (i % 11 == 0).alias("dismissed"),
    )


@query(
    f"""WITH {_GROUPED}, g AS (SELECT doc, grp, bool_or(dismissed) AS d, count(*) FILTER (WHERE include) AS i FROM m GROUP BY ALL) SELECT doc, count(*) FILTER (WHERE NOT d AND i >= 2) AS n FROM g GROUP BY doc"""
)
def unreviewed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each record are still to be reviewed."""
    return U.unreviewed(_grouped(spark, sf_dir), "doc", "grp")


@query(
    f"""WITH {_GROUPED}, k AS (SELECT *, id % 7 = 0 AS out FROM m), l AS (SELECT *, count(*) FILTER (WHERE NOT out) OVER (PARTITION BY grp) AS n, bool_or(out) OVER (PARTITION BY grp) AS touched FROM k)
SELECT id, CASE WHEN NOT touched OR NOT out AND n >= 2 THEN grp END AS grp FROM l"""
)
def removed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members left in their groups after some are taken out; a group of one dissolves."""
    members = _grouped(spark, sf_dir)
    return U.without_member(members, members.where("id % 7 = 0").select("id"), "grp", "id").select("id", "grp")


@query(
    f"""WITH {_GROUPED}, f AS (SELECT DISTINCT grp, grp % 5 <> 0 AS passes, CASE WHEN grp % 3 = 0 THEN 0.97 ELSE 0.5 END AS similarity FROM m),
k AS (SELECT id, grp, similarity, CASE WHEN similarity >= 0.95 THEN 'similarity' ELSE 'confirmed' END AS how, count(*) OVER (PARTITION BY grp) AS n FROM m JOIN f USING (grp) WHERE passes AND (similarity >= 0.95 OR grp % 7 = 0 OR id % 3 = 0 AND id % 2 = 0))
SELECT id, grp, similarity, how FROM k WHERE n >= 2"""
)
def confirmed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that similarity or an external confirmation upholds."""
    members = _grouped(spark, sf_dir).select("id", "grp")
    facts = members.select("grp").distinct().select("grp", (F.col("grp") % 5 != 0).alias("passes"), F.when(F.col("grp") % 3 == 0, 0.97).otherwise(0.5).alias("similarity"))
    verdicts = members.where("id % 2 = 0 OR grp % 7 = 0").select("id", (F.col("id") % 3 == 0).alias("same"), (F.col("grp") % 7 == 0).alias("failed"))
    return U.confirmed(members, facts, verdicts, "grp", "id")


@query(
    f"""WITH {_GROUPED}, g AS (SELECT id, dense_rank() OVER (ORDER BY grp) AS n FROM m WHERE grp % 3 = 0) SELECT id, n AS dupe_group, CASE WHEN n IS NOT NULL THEN 0.9 END AS dupe_similarity, false AS dupe_dismissed, include AS dupe_primary FROM m LEFT JOIN g USING (id)"""
)
def renumbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their grouping written anew; the copy that was kept stays marked."""
    rows = _grouped(spark, sf_dir)
    stored = rows.select(
        "id", F.col("grp").alias("dupe_group"), F.lit(0.1).alias("dupe_similarity"), F.col("dismissed").alias("dupe_dismissed"), F.col("include").alias("dupe_primary")
    )
    groups = rows.where("grp % 3 = 0").select("id", "grp")
    numbers = ranked(groups.select("grp"), "grp", "n")
    return U.renumbered(stored, groups.join(numbers, "grp").select("id", F.col("n").alias("grp"), F.lit(0.9).alias("similarity")), "id")


@query()
def lowest_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest similarity of any two turns of each role in a conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("grp"), "turn", "text")
    return U.lowest_ratios(turns, "grp", "turn")


def review_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as review rows with an old grouping, and the verdicts of the confirmation."""
    i = F.col("doc_id")
    date = F.when(i % 9 == 0, "-").otherwise(F.concat(F.lit("0"), (F.length(F.coalesce("text", F.lit(""))) % 2 + 1).cast("string"), F.lit("/02/2020")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", date.alias("date"), F.coalesce("lang", F.lit("-")).alias("title"), F.coalesce("source", F.lit("-")).alias("category"),
        F.lit(7).cast("bigint").alias("dupe_group"), F.lit(0.5).alias("dupe_similarity"), F.lit(True).alias("dupe_dismissed"),
    )
    verdicts = rows.where(i % 5 != 1).select("doc_id", (i % 3 != 0).alias("same"), (i % 7 == 0).alias("failed"))
    return rows, verdicts


@query()
def duplicate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of documents from their texts: clusters, gate, similarity, confirmation, and the grouping written anew."""
    rows, verdicts = review_rows(spark, sf_dir)
    return U.reviewed(rows, verdicts, "doc_id", "doc_id").select("doc_id", "dupe_group", "dupe_similarity", "dupe_dismissed")
