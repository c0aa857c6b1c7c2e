"""Review rows: validation, reconciliation by natural key, joins and data modification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.operators.order import spare

#: Error codes of row validation, in the order they are tested.
ERRORS = ("not an integer", "out of range", "overlaps the row before", "unknown category")


def row_errors(rows: DataFrame, sizes: DataFrame, categories: list[str], key: str, order: str, running: bool = False) -> DataFrame:
    """``key, order, error``: the first fault of every faulty row.

    ``start`` and ``end`` are texts as they come in.  A row must begin after the
    end of the row before it or, with ``running``, after the furthest end so far.
    """
    whole = lambda c: F.when(F.trim(c).rlike("^-?[0-9]+$"), F.trim(c).try_cast("int"))
    typed = rows.join(sizes, key).withColumns({"_s": whole(F.col("start")), "_e": whole(F.col("end"))})
    by_row = Window.partitionBy(key).orderBy(order)
    before = F.max("_e").over(by_row.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("_e").over(by_row)
    error = (
        F.when(F.col("_s").isNull() | F.col("_e").isNull(), ERRORS[0])
        .when(~((F.col("_s") >= 1) & (F.col("_s") <= F.col("_e")) & (F.col("_e") <= F.col("n"))), ERRORS[1])
        .when(F.col("_s") <= F.coalesce("_before", F.lit(0)), ERRORS[2])
        .when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), ERRORS[3])
    )
    return typed.withColumn("_before", before).select(key, order, error.alias("error")).where("error IS NOT NULL")


def first_error(errors: DataFrame, key: str, order: str) -> DataFrame:
    """``key, order, error`` of each record's first faulty row."""
    return errors.groupBy(key).agg(F.min(order).alias(order), F.min_by("error", order).alias("error"))


def carry_over(new: DataFrame, old: DataFrame, carried: dict[str, Column], key: list[str]) -> DataFrame:
    """New rows with the old rows' columns where the natural key is unchanged, else defaults."""
    kept = old.select(*key, *carried, F.lit(True).alias("_known"))
    return new.join(kept, key, "left").select(
        *new.columns, *[F.when(F.col("_known"), F.col(c)).otherwise(default).alias(c) for c, default in carried.items()]
    )


def reopened_groups(new: DataFrame, old: DataFrame, key: list[str], group: str) -> DataFrame:
    """Old rows of the groups that lost a member's natural key."""
    lost = old.where(F.col(group).isNotNull()).join(new, key, "left_anti").select(key[0], group).distinct()
    return old.join(lost, [key[0], group], "left_semi")


def reconcile(wanted: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """``key, status``: what to do with every natural key.

    ``keep`` the first existing row of a wanted key, ``repeat`` its others,
    ``stale`` what nobody wants, ``pending`` what is missing.
    """
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    ranked = existing.withColumn("_n", first)
    kept = ranked.join(wanted, key, "left_semi").select(*key, order, F.when(F.col("_n") == 1, "keep").otherwise("repeat").alias("status"))
    stale = ranked.join(wanted, key, "left_anti").select(*key, order, F.lit("stale").alias("status"))
    missing = wanted.select(*key).distinct().join(existing, key, "left_anti")
    kind = existing.schema[order].dataType
    pending = missing.select(*key, F.lit(None).cast(kind).alias(order), F.lit("pending").alias("status"))
    return kept.unionByName(stale).unionByName(pending)


def upsert_success_wins(attempts: DataFrame, key: list[str], ok: str, order: str) -> DataFrame:
    """One row a key: the first success, else the first failure; of ties the one of the smallest row hash."""
    n = spare(attempts, "_n")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ok).desc_nulls_last(), order, F.xxhash64("*")))
    return attempts.withColumn(n, first).where(F.col(n) == 1).drop(n)


def missing_pages(sizes: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages 1..n without a successful row."""
    every = sizes.select(key, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"))
    return every.join(stored.where("ok"), [key, "page"], "left_anti")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key; of ties the one of the smallest row hash."""
    n = spare(rows, "_n")
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc(), F.xxhash64("*")))
    return rows.withColumn(n, last).where(F.col(n) == 1).drop(n)


def verdicts(rows: DataFrame, table: DataFrame, key: list[str], column: str, default: Column) -> DataFrame:
    """Rows with an external call's verdict, or the call's failure default."""
    return rows.join(table.select(*key, F.col(column).alias("_v")), key, "left").withColumn(column, F.coalesce("_v", default)).drop("_v")


def memoise(wanted: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keys in an append-only verdict table."""
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


def patch(base: DataFrame, changes: DataFrame, key: list[str], columns: dict[str, int]) -> DataFrame:
    """Base rows with only the supplied fields changed, each cut to its width.

    ``changes`` has, for every column, ``has_<column>``: a supplied null counts.
    """
    found = changes.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], *[f"has_{c}" for c in columns])
    joined = base.join(found, key, "left")
    values = {
        c: F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.left(F.col(f"_{c}"), F.lit(width))).otherwise(F.col(c))
        for c, width in columns.items()
    }
    return joined.withColumns(values).select(*base.columns)


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows without those of the records that the new rows belong to, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted, key, "left_anti")


def seed_if_empty(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """The existing rows, or the seeds where there are none."""
    some = existing.limit(1).select(F.lit(True).alias("_some"))
    return existing.unionByName(seeds.join(some, F.lit(True), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new, key, "left_anti").unionByName(new)


def compare_and_set(rows: DataFrame, change: DataFrame, key: str, state: str, only_when: list[str]) -> DataFrame:
    """Rows with a new state where the present one allows it."""
    found = change.select(key, F.col(state).alias("_new"))
    allowed = F.col("_new").isNotNull() & F.col(state).isin(*only_when)
    return rows.join(found, key, "left").withColumn(state, F.when(allowed, F.col("_new")).otherwise(F.col(state))).select(*rows.columns)


def effective(*layers: Column) -> Column:
    """The first layer that is not null: an empty edit wins."""
    return F.coalesce(*layers)


def same_span_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, same``: whether two sides hold equal, non-empty sets of spans."""
    spans = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(name))
    return spans(a, "_a").join(spans(b, "_b"), key).select(key, (F.col("_a") == F.col("_b")).alias("same"))


def header_shape(read: DataFrame) -> DataFrame:
    """Header fields under the names they are stored by; a field that was not read is empty."""
    names = {"first_name": "patient_first_name", "last_name": "patient_last_name", "dob": "patient_dob", "lawfirm": "law_firm"}
    return read.withColumnsRenamed(names).na.fill("", list(names.values()))


def first_known(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``key`` and each column's first value that is not null, in order; null where all are."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in columns])


def with_live(summaries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Summaries with ``live``: the category that the row of their span has now, or null where its boundary moved."""
    now = rows.select(key, "start", "end", F.col("category").alias("live"))
    return summaries.join(now, [key, "start", "end"], "left")


def retried(attempts: DataFrame, key: str, retries: int = 1) -> DataFrame:
    """``key, page, ok, tries`` of pages read again after errors: the first success, or the last of ``retries`` more attempts.

    ``attempts`` gives ``key, page, attempt, ok`` with attempts from 0; later ones are not made.
    """
    made = attempts.where(F.col("attempt") <= retries)
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    grouped = made.groupBy(key, "page").agg(first.alias("_f"), F.max("attempt").alias("_l"))
    return grouped.select(key, "page", F.col("_f").isNotNull().alias("ok"), (F.coalesce("_f", "_l") + 1).alias("tries"))
