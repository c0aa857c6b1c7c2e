"""Evaluation: boundaries, spans, rankings, and paired comparisons of arms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.operators.order import running_sums
from quirewise.operators.spans import span_pages


def ratio(a: Column, b: Column) -> Column:
    """A share, 0 where there is nothing to share."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, truth: Column, guess: Column, key: list[str] | None = None) -> DataFrame:
    """``tp, fp, fn, tn`` of two flags, by key or in all."""
    return rows.groupBy(*(key or [])).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
    )


def boundary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, MCC, kappa and balanced accuracy of confusion counts.

    Shares of nothing are 0; the correlation is null where the truth is of one kind.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when((tp + fn == 0) | (tn + fp == 0), None).otherwise(ratio(tp * tn - fp * fn, root))
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return counts.select(
        *[c for c in counts.columns if c not in ("tp", "fp", "fn", "tn")],
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        mcc.alias("mcc"),
        ratio((tp + tn) / n - chance, 1 - chance).alias("kappa"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def span_scores(predicted: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, exact_f1, weighted_f1, over_segmentation`` of two sets of spans."""
    both = predicted.select(key, "start", "end").join(truth.select(key, "start", "end"), [key, "start", "end"])
    size = F.sum(F.col("end") - F.col("start") + 1)
    agg = lambda df, n, w: df.groupBy(key).agg(F.count("*").alias(n), size.alias(w))
    joined = agg(truth, "_g", "_wg").join(agg(predicted, "_p", "_wp"), key, "full").join(agg(both, "_b", "_wb"), key, "left").na.fill(0)
    return joined.select(
        key,
        ratio(2 * F.col("_b"), F.col("_p") + F.col("_g")).alias("exact_f1"),
        ratio(2 * F.col("_wb"), F.col("_wp") + F.col("_wg")).alias("weighted_f1"),
        ratio(F.col("_p"), F.col("_g")).alias("over_segmentation"),
    )


def nearest(points: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, near``: each point's nearest target, the smaller of two equally near.

    Two passes over the points and targets of a record in order; no pairs are made.
    """
    every = points.select(key, "start", F.lit(1).alias("_q")).unionByName(targets.select(key, "start", F.lit(0).alias("_q")))
    target = F.when(F.col("_q") == 0, F.col("start"))
    by_start = Window.partitionBy(key).orderBy("start", "_q")
    back = F.last(target, ignorenulls=True).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(target, ignorenulls=True).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(ahead.isNull() | (F.col("start") - back <= ahead - F.col("start")), back).otherwise(ahead)
    marked = every.withColumn("near", near)
    return marked.where("_q = 1").select(key, "start", "near")



def triage(predicted: DataFrame, truth: DataFrame, tolerance: int = 2, key: str = "doc_id") -> DataFrame:
    """``key, start, kind``: true starts found, shifted or missed, and extra predicted ones."""
    found = nearest(truth, predicted, key).withColumn("_d", F.abs(F.col("near") - F.col("start")))
    kinds = F.when(F.col("_d") == 0, "exact").when(F.col("_d") <= tolerance, "shifted").otherwise("missed")
    extra = nearest(predicted, truth, key).where(F.coalesce(F.abs(F.col("near") - F.col("start")) > tolerance, F.lit(True)))
    return found.select(key, "start", kinds.alias("kind")).unionByName(extra.select(key, "start", F.lit("extra").alias("kind")))


def recovered(predicted: DataFrame, truth: DataFrame, tolerance: int, key: str = "doc_id") -> DataFrame:
    """Predicted starts with near ones snapped to the truth and far ones dropped."""
    near = nearest(predicted, truth, key).where(F.abs(F.col("near") - F.col("start")) <= tolerance)
    return near.select(key, F.col("near").alias("start")).distinct()


def window_metrics(pages: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``key, windowdiff, pk`` from ``key, page, ref, hyp`` boundary marks and a window of ``k``."""
    by_page = Window.partitionBy(key).orderBy("page")
    ahead = by_page.rowsBetween(0, k - 1)
    sums = pages.select(
        key, F.count("*").over(ahead).alias("_n"), F.sum("ref").over(ahead).alias("_r"), F.sum("hyp").over(ahead).alias("_h")
    ).where(F.col("_n") == k)
    differ = lambda c: F.avg(c.cast("double"))
    return sums.groupBy(key).agg(
        differ(F.col("_r") != F.col("_h")).alias("windowdiff"), differ((F.col("_r") > 0) != (F.col("_h") > 0)).alias("pk")
    )


def span_match(predicted: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, exact, over_split, under_split, misaligned``: what became of the true spans.

    Exact: predicted as it is.  Over-split: of its pages no predicted span is
    shared with another.  Under-split: within one predicted span.
    """
    pages = span_pages(predicted.select(key, F.col("start").alias("ps"), F.col("end").alias("pe"), "start", "end")).select(key, "page", "ps", "pe")
    joined = span_pages(truth).join(pages, [key, "page"], "left").select(key, "start", "end", "ps", "pe").distinct()
    inside = (F.col("ps") >= F.col("start")) & (F.col("pe") <= F.col("end"))
    facts = joined.groupBy(key, "start", "end").agg(
        F.bool_or((F.col("ps") == F.col("start")) & (F.col("pe") == F.col("end"))).alias("e"),
        F.bool_and(F.coalesce(inside, F.lit(False))).alias("o"),
        F.bool_or((F.col("ps") <= F.col("start")) & (F.col("pe") >= F.col("end"))).alias("u"),
    )
    kind = F.when(F.col("e"), "exact").when(F.col("o"), "over").when(F.col("u"), "under").otherwise("mis")
    rated = facts.withColumn("kind", kind)
    return rated.groupBy(key).agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("exact", "exact"), ("over", "over_split"), ("under", "under_split"), ("mis", "misaligned"))]
    )


def best_shift(predicted: DataFrame, truth: DataFrame, reach: int = 10, key: str = "doc_id") -> DataFrame:
    """``key, shift, hits``: the constant offset under which most true starts are predicted; ties to the smallest."""
    moved = truth.select(key, "start", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"))
    hits = moved.select(key, "shift", (F.col("start") + F.col("shift")).alias("start")).join(predicted.distinct(), [key, "start"])
    counted = hits.groupBy(key, "shift").agg(F.count("*").alias("hits"))
    best = counted.groupBy(key).agg(F.max(F.struct("hits", (-F.abs("shift")).alias("a"), (-F.col("shift")).alias("b"))).alias("_m"))
    return best.select(key, (-F.col("_m.b")).alias("shift"), F.col("_m.hits").alias("hits"))


def curve(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``score, tp, fp, positives, negatives``: running counts from the highest score, equal scores together."""
    tied = rows.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q")).withColumn("_down", -F.col(score))
    summed = running_sums(tied, "_down", ["p", "q"])
    whole = tied.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("q"), F.lit(0)).alias("negatives"))
    return summed.crossJoin(F.broadcast(whole)).select(  # one row of totals
        score, F.col("p_upto").alias("tp"), F.col("q_upto").alias("fp"), "positives", "negatives", "p", "q"
    )


def average_precision(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``average_precision, roc_auc`` of a ranking; the area is null where one class is missing."""
    points = curve(rows, score, label)
    ap = F.sum(ratio(F.col("p"), F.col("positives")) * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    auc = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)) / F.max(F.col("positives") * F.col("negatives"))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return points.agg(ap.alias("average_precision"), F.when(both, auc).alias("roc_auc"))


def best_f1(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``threshold, f1``: the threshold of the best F1; of equal ones the highest."""
    points = curve(rows, score, label)
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))
    return points.agg(F.max(F.struct(f1.alias("f"), F.col(score).alias("s"))).alias("_m")).select(
        F.col("_m.s").alias("threshold"), F.col("_m.f").alias("f1")
    )


def _beyond_stirling(n: Column) -> Column:
    """What the logarithm of n! has beyond Stirling's formula: its series, and below 16 the factorial itself."""
    small = F.log(F.factorial(F.least(n, F.lit(16)))) - (n + 0.5) * F.log(F.greatest(n, F.lit(1))) + n - 0.5 * math.log(2 * math.pi)
    large = F.greatest(n, F.lit(1)).cast("double")
    x = 1.0 / (large * large)
    series = (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x / 1188)))) / large
    return F.when(n == 0, 0.0).when(n < 16, small).otherwise(series)


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test; 1 where nothing was decided.

    Twice the chance of at least k of n heads.  The chance of exactly k is put as
    its distance from the middle, so nothing large cancels, and each term behind it
    is made from the one before.  Term i is below exp(-2 i^2 / n) of the first, so
    five times the root of n of them are all that a double can tell.
    """
    n, k = (wins + losses).cast("bigint"), F.greatest(wins, losses).cast("bigint")
    rest = n - k
    t = (k - rest) / F.greatest(n, F.lit(1))
    away = n / 2 * (F.log1p(-t * t) + t * (F.log1p(t) - F.log1p(-t)))
    size = F.sqrt(n / (2 * math.pi * F.greatest(k, F.lit(1)) * F.greatest(rest, F.lit(1))))
    first = F.when(rest == 0, F.exp(-n * math.log(2))).otherwise(
        size * F.exp(_beyond_stirling(n) - _beyond_stirling(k) - _beyond_stirling(rest) - away)
    )
    last = F.least(rest, F.ceil(5 * F.sqrt(n)) + 10)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), last),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (rest - i) / (k + i + 1)).cast("double").alias("term")),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * first * tail))


def compare_arms(scores: DataFrame, base: str, contender: str) -> DataFrame:
    """``document, gap, noise, clears`` of two arms.

    ``scores`` gives ``document, arm, metric`` for every repeat.  A gap clears
    the noise where it is above the wider of the arms' ranges; with a single run
    of an arm that is unmeasured, null.
    """
    summed = scores.groupBy("document", "arm").agg(
        F.avg("metric").alias("m"), (F.max("metric") - F.min("metric")).alias("r"), F.count("*").alias("n")
    )
    a = summed.where(F.col("arm") == base).select("document", F.col("m").alias("ma"), F.col("r").alias("ra"), F.col("n").alias("na"))
    b = summed.where(F.col("arm") == contender).select("document", F.col("m").alias("mb"), F.col("r").alias("rb"), F.col("n").alias("nb"))
    gap, noise = F.col("mb") - F.col("ma"), F.greatest("ra", "rb")
    measured = (F.col("na") > 1) & (F.col("nb") > 1)
    return a.join(b, "document").select("document", gap.alias("gap"), noise.alias("noise"), F.when(measured, F.abs(gap) > noise).alias("clears"))


def outcome(compared: DataFrame) -> DataFrame:
    """``wins, losses, ties, p_value`` over documents."""
    counts = compared.agg(
        F.count_if(F.col("gap") > 0).alias("wins"), F.count_if(F.col("gap") < 0).alias("losses"), F.count_if(F.col("gap") == 0).alias("ties")
    )
    return counts.withColumn("p_value", sign_test(F.col("wins"), F.col("losses")))


def complete_documents(scores: DataFrame, arms: list[str], repeats: int) -> DataFrame:
    """``document, complete``: whether every arm ran often enough."""
    counts = [F.count_if(F.col("arm") == a) >= repeats for a in arms]
    done = counts[0]
    for c in counts[1:]:
        done = done & c
    return scores.groupBy("document").agg(done.alias("complete"))


def votes(starts: DataFrame, runs: DataFrame) -> DataFrame:
    """``document, page, share, unstable, majority``: in how many runs a page started something; page 1 is free."""
    total = runs.groupBy("document").agg(F.countDistinct("rep").alias("_n"))
    counted = starts.where("page > 1").groupBy("document", "page").agg(F.countDistinct("rep").alias("_c"))
    share = F.col("_c") / F.col("_n")
    return counted.join(total, "document").select(
        "document", "page", share.alias("share"), (share < 1).alias("unstable"), (share > 0.5).alias("majority")
    )


def mcnemar(base: DataFrame, contender: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, base_only, contender_only, p_value``: pages that one side alone has right.

    Pages that no side and no truth names are agreed on and not counted.
    """
    flag = lambda df, n: df.select(key, "start", *[F.lit(int(x == n)).alias(x) for x in "bct"])
    merged = flag(base, "b").union(flag(contender, "c")).union(flag(truth, "t")).where("start > 1")
    page = merged.groupBy(key, "start").agg(*[F.max(x).alias(x) for x in "bct"])
    right = lambda x: F.col(x) == F.col("t")
    counts = page.groupBy(key).agg(
        F.count_if(right("b") & ~right("c")).alias("base_only"), F.count_if(right("c") & ~right("b")).alias("contender_only")
    )
    return counts.withColumn("p_value", sign_test(F.col("contender_only"), F.col("base_only")))


def known_mean(column: Column) -> Column:
    """The mean of the values that are numbers: null and NaN count as absent, none gives null."""
    return F.avg(F.when(~F.isnan(column), column))


def near_misses(points: DataFrame, targets: DataFrame, reach: int = 2, key: str = "doc_id") -> DataFrame:
    """``key, start``: points that are no target, but have one within ``reach`` pages."""
    around = targets.select(key, F.explode(F.sequence(F.col("start") - reach, F.col("start") + reach)).alias("start")).distinct()
    missed = points.select(key, "start").distinct().join(targets.select(key, "start"), [key, "start"], "left_anti")
    return missed.join(around, [key, "start"], "left_semi")


def shifted(starts: DataFrame, shifts: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start``: starts moved by each record's constant, clamped to its pages; no shift is 0."""
    moved = starts.join(sizes, key).join(shifts.select(key, "shift"), key, "left").withColumn("_s", F.col("start") + F.coalesce("shift", F.lit(0)))
    return moved.select(key, F.least(F.greatest("_s", F.lit(1)), "n").alias("start")).distinct()
