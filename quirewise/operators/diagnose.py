"""Where segmentations fail: error classes, seams, damage by merging, and how far to trust an oracle.

Starts are rows of ``key, start`` and spans rows of ``key, start, end``, all within
a record.  Repeated rows count once where sets are compared; a record that one
side does not have counts as empty there; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.operators import evaluate as E
from quirewise.operators.spans import span_pages, tile

#: Pages by which a start may be off and still be near; a fixed value.
NEAR = 2


def union_of(cues: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """``key, start``: the starts that any of the cues names."""
    return reduce(DataFrame.unionByName, [c.select(key, "start") for c in cues]).distinct()


def _within(points: DataFrame, targets: DataFrame, reach: int, key: str) -> DataFrame:
    """``points`` that have a target within ``reach`` pages, by equality on widened targets."""
    around = targets.select(key, F.explode(F.sequence(F.col("start") - reach, F.col("start") + reach)).alias("start")).distinct()
    return points.join(around, [key, "start"], "left_semi")


def start_errors(predicted: DataFrame, truth: DataFrame, truth_spans: DataFrame, seams: DataFrame, reach: int = NEAR, key: str = "doc_id") -> DataFrame:
    """``key, start, kind`` of every wrong start.

    A false start is a ``seam`` where a chunk begins, else ``near`` a true start,
    else an ``over_split`` inside a true span, else ``unlabeled``.  A true start that
    is not predicted is ``missed_near`` a predicted one or ``missed_hard``.
    """
    guesses, starts = predicted.select(key, "start").distinct(), truth.select(key, "start").distinct()
    seam = seams.select(key, "start").distinct().withColumn("_seam", F.lit(True))
    near = _within(guesses, starts, reach, key).withColumn("_near", F.lit(True))
    inside = span_pages(truth_spans).select(key, F.col("page").alias("start")).distinct().withColumn("_inside", F.lit(True))
    false = guesses.join(starts, [key, "start"], "left_anti")
    marked = false.join(seam, [key, "start"], "left").join(near, [key, "start"], "left").join(inside, [key, "start"], "left")
    kind = F.when(F.col("_seam"), "seam").when(F.col("_near"), "near").when(F.col("_inside"), "over_split").otherwise("unlabeled")
    missed = starts.join(guesses, [key, "start"], "left_anti")
    soft = _within(missed, guesses, reach, key).withColumn("_near", F.lit(True))
    lost = missed.join(soft, [key, "start"], "left").select(key, "start", F.when(F.col("_near"), "missed_near").otherwise("missed_hard").alias("kind"))
    return marked.select(key, "start", kind.alias("kind")).unionByName(lost)


def severed(spans: DataFrame, seams: DataFrame, key: str = "doc_id") -> DataFrame:
    """The spans that a seam cuts: one after their first page and not after their last."""
    pages = span_pages(spans).where("page > start")
    return pages.join(seams.select(key, F.col("start").alias("page")).distinct(), [key, "page"], "left_semi").select(*spans.columns).distinct()


def worst_split(errors: DataFrame, truth_spans: DataFrame, most: int = 5, key: str = "doc_id") -> DataFrame:
    """``key, start, end, pieces``: each record's true spans that over-splits cut most, ties in order of pages."""
    cuts = errors.where("kind = 'over_split'").select(key, F.col("start").alias("page"))
    counted = span_pages(truth_spans).join(cuts, [key, "page"]).groupBy(key, "start", "end").agg(F.count("*").alias("pieces"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("pieces").desc(), "start", "end"))
    return counted.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def chunk_coverage(rows: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, k, gaps, overlaps``: pages that a chunk's rows leave out, and that they repeat.

    ``rows`` gives ``key, k, start, end``, ``chunks`` ``key, k, first, last``.
    The furthest end so far is where the next row should begin.
    """
    before = Window.partitionBy(key, "k").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    walked = rows.join(chunks, [key, "k"]).withColumn("_at", F.greatest("first", F.coalesce(reach + 1, "first")))
    sums = walked.groupBy(key, "k").agg(
        F.sum(F.greatest(F.col("start") - F.col("_at"), F.lit(0))).alias("_g"),
        F.sum(F.greatest(F.col("_at") - F.col("start"), F.lit(0))).alias("_o"),
        F.max("end").alias("_e"),
    )
    tail = F.greatest(F.col("last") - F.greatest(F.coalesce("_e", F.col("first") - 1), F.col("first") - 1), F.lit(0))
    return chunks.join(sums, [key, "k"], "left").select(
        key, "k", (F.coalesce("_g", F.lit(0)) + tail).cast("bigint").alias("gaps"), F.coalesce("_o", F.lit(0)).cast("bigint").alias("overlaps")
    )


def harmed(truth: DataFrame, before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start``: true starts that were there before a merge and are not after it."""
    one = lambda df: df.select(key, "start")
    return one(truth).intersect(one(before)).exceptAll(one(after).distinct().intersect(one(truth)))


def offset_verdict(truth: DataFrame, evidence: DataFrame, reach: int = 10, key: str = "doc_id") -> DataFrame:
    """``key, hits, shift, best, verdict``: whether printed page numbers say that a record's truth is off by a constant.

    An offset must beat none clearly; ties go to the smallest offset.
    """
    moved = truth.select(key, "start", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"))
    found = moved.select(key, "shift", (F.col("start") + F.col("shift")).alias("start")).join(evidence.select(key, "start").distinct(), [key, "start"])
    counted = found.groupBy(key, "shift").agg(F.count("*").alias("n"))
    facts = counted.groupBy(key).agg(
        F.max(F.when(F.col("shift") == 0, F.col("n"))).alias("_zero"),
        F.max(F.struct("n", (-F.abs("shift")).alias("a"), (-F.col("shift")).alias("b"))).alias("_m"),
    )
    both = truth.select(key).distinct().join(facts, key, "left").select(
        key, F.coalesce("_zero", F.lit(0)).alias("hits"), F.coalesce(-F.col("_m.b"), F.lit(0)).alias("shift"), F.coalesce("_m.n", F.lit(0)).alias("best")
    )
    clear = F.greatest(F.col("hits") + 3, F.floor(F.greatest(F.col("hits"), F.lit(1)) * 1.5))
    verdict = F.when((F.col("shift") != 0) & (F.col("best") >= clear), "offset").when(F.col("best") == 0, "inconclusive").otherwise("aligned")
    return both.withColumn("verdict", verdict)


def suggestion_scores(suggested: DataFrame, rows: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, suggestions, correct, precision, coverage`` of suggested merges.

    A suggestion is correct where its start is not true; coverage is the share of
    the rows' false starts, other than page 1, that are suggested.  Shares of
    nothing are 0.
    """
    flag = lambda df, c: df.select(key, "start", *[F.lit(int(x == c)).alias(x) for x in "srt"])
    merged = flag(suggested, "s").union(flag(rows, "r")).union(flag(truth, "t")).groupBy(key, "start").agg(*[F.max(x).alias(x) for x in "srt"])
    counts = merged.groupBy(key).agg(
        F.sum("s").cast("bigint").alias("suggestions"),
        F.count_if((F.col("s") == 1) & (F.col("t") == 0)).alias("correct"),
        F.count_if((F.col("r") == 1) & (F.col("t") == 0) & (F.col("start") != 1)).alias("_over"),
    )
    return counts.select(
        key, "suggestions", "correct", E.ratio(F.col("correct"), F.col("suggestions")).alias("precision"), E.ratio(F.col("correct"), F.col("_over")).alias("coverage")
    )


def oracle_reliability(verdicts: DataFrame, yes: str, key: list[str]) -> DataFrame:
    """Boundary metrics of an oracle's answers, with the number of null answers, which count as no.

    ``verdicts`` gives ``key, truth, answer``.
    """
    said = F.coalesce(F.col("answer") == yes, F.lit(False))
    nulls = verdicts.groupBy(*key).agg(F.count_if(F.col("answer").isNull()).alias("nulls"), F.count("*").alias("asked"))
    return E.boundary_metrics(E.confusion(verdicts, F.col("truth"), said, key)).join(nulls, key)


def scores_of(predicted: DataFrame, truth: DataFrame, sizes: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """All segmentation metrics of a record in one row: boundaries, spans, windows of ``k`` and mean offset."""
    guesses, starts = predicted.select(key, "start").distinct(), truth.select(key, "start").distinct()
    marks = guesses.withColumn("hyp", F.lit(1)).join(starts.withColumn("ref", F.lit(1)), [key, "start"], "full")
    every = sizes.select(key, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"))
    pages = every.join(marks.withColumnRenamed("start", "page"), [key, "page"], "left").na.fill(0, ["hyp", "ref"])
    bounds = E.boundary_metrics(E.confusion(pages, F.col("ref") == 1, F.col("hyp") == 1, [key]))
    spans = E.span_scores(tile(guesses, sizes, key), tile(starts, sizes, key), key)
    # Page 1 always starts a span; it is no boundary.
    inner = pages.select(key, "page", *[F.when(F.col("page") == 1, 0).otherwise(F.col(c)).alias(c) for c in ("ref", "hyp")])
    offset = E.nearest(starts, guesses, key).groupBy(key).agg(F.avg(F.abs(F.col("near") - F.col("start"))).alias("offset"))
    return bounds.join(spans, key).join(E.window_metrics(inner, k, key), key, "left").join(offset, key, "left")


def precision_at_recall(rows: DataFrame, share: float = 0.5, key: str = "record", score: str = "score", label: str = "label") -> DataFrame:
    """``key, hits, flagged, precision`` when flagging from the highest score until a share of the positives is found.

    Rows of equal score are flagged together, as nothing orders them.  One hit at
    least is asked for; a record without positives has flagged all and precision 0.
    """
    tied = rows.groupBy(key, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy(key).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = tied.groupBy(key).agg(F.sum("p").alias("_all"))
    run = tied.select(key, F.sum("p").over(down).alias("hits"), F.sum("n").over(down).alias("flagged")).join(whole, key)
    enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("_all") * share))
    first = run.groupBy(key).agg(
        F.min(F.when(enough, F.struct("flagged", "hits"))).alias("_f"), F.max(F.struct("flagged", "hits")).alias("_l")
    ).select(key, F.coalesce("_f", "_l").alias("_f"))
    hits, flagged = F.col("_f.hits"), F.col("_f.flagged")
    return first.select(key, hits.alias("hits"), flagged.alias("flagged"), E.ratio(hits, flagged).alias("precision"))


def one_copy_rows(rows: DataFrame, documents: DataFrame, digest: str, order: list[str], key: str = "doc_id") -> DataFrame:
    """The rows of the earliest document of each file digest, so that no file counts twice."""
    first = documents.groupBy(digest).agg(F.min(F.struct(*order, key)).alias("_first")).select(F.col(f"_first.{key}").alias(key))
    return rows.join(first, key, "left_semi")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two whole numbers."""
    return F.bit_count(a.bitwiseXOR(b))
