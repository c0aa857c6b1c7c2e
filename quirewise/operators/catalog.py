"""The category catalog: listings, defaults, preambles, guarded changes and revisions.

A category is ``id, name, active, auto_assign, summarize`` with a number as a
text for its id.  An empty catalog is replaced by the built-in one; unknown ids
get the defaults that leave nothing out; of repeated ids the last edit holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories by what their documents can contain.
EXAMS = ("1", "2", "5", "6", "12", "13")
VERDICTS = ("3", "14")
DEPOSITIONS = ("9",)
EMBEDDED_REVIEWS = ("12", "13")
PLAIN = ("4", "7", "8", "10", "11", "15", "100")
KNOWN = (*EXAMS, *VERDICTS, *DEPOSITIONS, *PLAIN)


def by_number(column: str = "id") -> list[Column]:
    """The order of ids as numbers; ids that are none come last, as texts."""
    return [F.col(column).try_cast("int").asc_nulls_last(), F.col(column)]


def categories(stored: DataFrame, builtin: DataFrame, active_only: bool = False, auto_assign: bool = False) -> DataFrame:
    """The stored catalog, or the built-in one where nothing is stored: all, the active, or the assignable categories."""
    some = stored.limit(1).select(F.lit(True).alias("_some"))  # one row at most
    rows = stored.unionByName(builtin.join(some, F.lit(True), "left_anti"))
    if auto_assign:
        return rows.where("active AND auto_assign")
    return rows.where("active") if active_only else rows


def include_default(rows: DataFrame, catalog: DataFrame, category: str = "category") -> DataFrame:
    """Rows with ``include``: their category's default; an unknown category is included."""
    flags = catalog.select(F.col("id").alias(category), F.col("summarize").alias("_s"))
    return rows.join(flags, category, "left").withColumn("include", F.coalesce("_s", F.lit(True))).drop("_s")


def corpus_text(name: Column, description: Column, examples: Column) -> Column:
    """What stands for a category where texts are compared."""
    return F.concat(name, F.lit(". "), description, F.lit(" Examples: "), F.array_join(examples, "; "))


def preamble_blocks(category: Column) -> Column:
    """The names of the rule blocks that bind on a category, in order.

    An unknown category gets every block but the deposition format.
    """
    id_ = F.coalesce(category.cast("string"), F.lit(""))
    unknown = ~id_.isin(*KNOWN)
    exam, verdict, embedded = unknown | id_.isin(*EXAMS), unknown | id_.isin(*VERDICTS), unknown | id_.isin(*EMBEDDED_REVIEWS)
    when = lambda holds, *names: F.when(holds, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    always = lambda *names: F.array(*map(F.lit, names))
    return F.concat(
        always("factuality", "content", "scope"),
        when(exam, "normal_findings"),
        when(verdict, "verdict"),
        when(embedded, "embedded_review"),
        always("codes"),
        when(exam, "vitals", "pain", "range_of_motion"),
        always("format"),
        F.when(id_.isin(*DEPOSITIONS), always("deposition")).otherwise(always("one_paragraph")),
        always("bold", "sentence_case"),
    )


def preamble(category: Column, texts: dict[str, str]) -> Column:
    """The blocks' texts put together; a block without a text is empty."""
    known = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]) if texts else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(preamble_blocks(category), lambda b: F.coalesce(F.try_element_at(known, b), F.lit(""))), "")


def category_changes(requests: DataFrame, rows: DataFrame, busy: DataFrame, catalog: DataFrame, key: str = "doc_id") -> DataFrame:
    """``requests`` with ``outcome`` and the audit's ``detail``.

    A request gives ``key, idx, start, end, category``.  Refused are those of a
    record with an active job, for a category that is not active, and for a span
    that no row has any more; one that changes nothing leaves no trace.
    """
    running = busy.select(key).distinct().withColumn("_busy", F.lit(True))
    live = catalog.where("active").select(F.col("id").alias("category")).distinct().withColumn("_known", F.lit(True))
    now = rows.select(key, "start", "end", F.col("category").alias("_was"))
    joined = requests.join(running, key, "left").join(live, "category", "left").join(now, [key, "start", "end"], "left")
    outcome = (
        F.when(F.col("_busy"), "busy").when(F.col("_known").isNull(), "unknown").when(F.col("_was").isNull(), "moved")
        .when(F.col("_was") == F.col("category"), "same").otherwise("changed")
    )
    detail = F.format_string("idx %s pages %s-%s: %s -> %s", *[F.col(c).cast("string") for c in ("idx", "start", "end", "_was", "category")])
    return joined.withColumn("outcome", outcome).withColumn("detail", F.when(F.col("outcome") == "changed", detail)).select(
        *requests.columns, "outcome", "detail"
    )


def with_changes(rows: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with the accepted changes of category made; of several for a span that of the largest ``idx`` (then category)."""
    accepted = changes.where("outcome = 'changed'").groupBy(key, "start", "end")
    new = accepted.agg(F.max(F.struct("idx", "category")).alias("_c")).select(key, "start", "end", F.col("_c.category").alias("_new"))
    return rows.join(new, [key, "start", "end"], "left").withColumn("category", F.coalesce("_new", "category")).select(*rows.columns)


def revisions(edits: DataFrame, catalog: str, category: str, order: list[str]) -> DataFrame:
    """``catalog, category, revision, active``: the catalog's revision at each category's last edit, and whether it is still active.

    Every edit bumps the revision by one; ``deleted`` marks an edit that retires
    the category, which a later edit brings back.
    """
    bump = F.row_number().over(Window.partitionBy(catalog).orderBy(*order))
    numbered = edits.withColumn("_n", bump)
    last = numbered.groupBy(catalog, category).agg(F.max("_n").cast("bigint").alias("revision"), F.max_by("deleted", "_n").alias("_d"))
    return last.select(catalog, category, "revision", (~F.coalesce("_d", F.lit(False))).alias("active"))
