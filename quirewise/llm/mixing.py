"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token
weights are raked in turn to the target share of every source, every language
and every topic.  Each cell's sampling probability is then proportional to its
raked weight over its tokens, at most one, scaled such that the expected tokens
of the sample are the wanted share of the corpus.

Without explicit targets a value's target is its corpus share to the power
``temperature``, which lifts rare values.  Every value keeps its own target, of
however many there are: up to ``LOCAL_CELLS`` cells are raked in the driver and
broadcast, more of them as a Spark table that is joined.

Raking stops when every marginal is met to ``TOLERANCE``, or after ``ROUNDS``;
``marginals`` reports how well each target is met.  The topic is a rule on the
text's form, or any column or expression that is given as ``topic``.

Rows: null source, language or text count as empty ones; a text of no bytes
counts one token; a document's draw depends on its ``doc_id`` (a null one: on
its text), so repeated rows are drawn alike; an empty table gives an empty
result; other columns are passed on by ``mix``, ignored by ``probabilities``.
A value with documents but no target gets weight zero; one with a target but no
documents leaves its target to the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.columns import column

from .common import cut, read, text_or_empty

MARGINALS = ("source", "lang", "topic")
#: Cells that are raked in the driver, at most; more are raked as a table, to the same weights.
LOCAL_CELLS = 200_000
#: Rounds of raking at most; each rakes to all three marginals.
ROUNDS = 30
#: Raking stops when no marginal's shares are further from their targets, in sum.
TOLERANCE = 1e-13
#: Tokens of the sample as a share of the corpus.
SHARE = 0.8
TEMPERATURE = 0.5
BYTES_A_TOKEN = 4


def topic_of(text: Column) -> Column:
    """A topic by the form of the text: what a rule can tell of it without a model."""
    return (
        F.when(F.trim(text) == "", "blank")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """An estimate of a text's tokens."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / BYTES_A_TOKEN)).cast("bigint")


def draw_of(doc_id: Column, text: Column) -> Column:
    """A document's fixed draw in [0, 1)."""
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), text), F.lit(":mix")).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def rake(cells: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Scale weights until their sums by each grouping have the target shares.

    A group without weight keeps none; its target is left to the others.
    """
    weights = cells / max(cells.sum(), 1e-300)
    for _ in range(rounds):
        gap = 0.0
        for group, target in zip(groups, targets, strict=True):
            sums = np.bincount(group, weights, len(target))
            gap = max(gap, np.abs(sums - target).sum())
            weights = weights * np.divide(target, sums, out=np.zeros(len(target)), where=sums > 0)[group]
        if gap <= TOLERANCE:
            break
    return weights


def calibrate(weights: np.ndarray, tokens: np.ndarray, wanted: float) -> np.ndarray:
    """Probabilities in proportion to weight over tokens, at most 1, for the wanted tokens in all."""
    ratio = weights / tokens
    order = np.lexsort((np.arange(len(ratio)), -ratio))
    full = np.concatenate(([0.0], np.cumsum(tokens[order])))[:-1]
    left = np.cumsum(weights[order][::-1])[::-1]
    scale = np.divide(wanted - full, left, out=np.full(len(left), np.inf), where=left > 0)
    with np.errstate(invalid="ignore"):  # no weight left: infinite scale times zero
        fits = np.flatnonzero(scale * ratio[order] <= 1)
        best = scale[fits[0]] if len(fits) else np.inf
        return np.where(ratio > 0, np.minimum(1.0, ratio * best), 0.0)


def _keys(docs: DataFrame, *more: Column, topic: Column | str | None = None) -> DataFrame:
    text = text_or_empty()
    if topic is not None:
        own = F.col(f"`{topic}`") if isinstance(topic, str) else topic
        topic = F.coalesce(own.cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"),
        tokens_of(text).alias("n_tokens"),
        draw_of(F.col("doc_id"), text).alias("draw"),
        *more,
    )


def _rake_table(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None, temperature: float, rounds: int
) -> DataFrame:
    """``cells`` with their raked weight ``w``; what ``rake`` does, on a table of any size."""
    spark = cells.sparkSession
    total = max(cells.agg(F.sum("n")).first()[0] or 0.0, 1e-300)
    wanted = {}
    for m in MARGINALS:
        values = cells.groupBy(m).agg(F.sum("n").alias("n"))
        if targets and m in targets:
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], f"{m} string, g double")
            values = values.join(given, m, "left").select(m, F.coalesce("g", F.lit(0.0)).alias("g"))
        else:
            values = values.select(m, F.pow(F.col("n") / total, temperature).alias("g"))
        wanted[m] = cut(values)
        sums = max(wanted[m].agg(F.sum("g")).first()[0] or 0.0, 1e-300)
        wanted[m] = wanted[m].withColumn("g", F.col("g") / sums)
    now = cells.withColumn("w", F.col("n") / total)
    for _ in range(rounds):
        for m in MARGINALS:
            factor = now.groupBy(m).agg(F.sum("w").alias("s")).join(wanted[m], m)
            factor = factor.select(m, F.when(F.col("s") > 0, F.col("g") / F.col("s")).otherwise(0.0).alias("f"))
            now = now.join(factor, m).withColumn("w", F.col("w") * F.col("f")).drop("f")
        now = cut(now)
        # The last marginal is met by now; the others tell whether another round is due.
        sums = [now.groupBy(m).agg(F.sum("w").alias("s")).join(wanted[m], m) for m in MARGINALS[:-1]]
        if all((s.agg(F.sum(F.abs(F.col("s") - F.col("g")))).first()[0] or 0.0) <= TOLERANCE for s in sums):
            break
    return now


def _calibrate_table(raked: DataFrame, wanted: float) -> DataFrame:
    """``raked`` with its ``probability``; what ``calibrate`` does, on a table of any size.

    The cells taken in full only become more from step to step.
    """
    ratio = F.col("w") / F.col("n")
    best, full = 0.0, -1
    while True:
        sure = ratio * F.lit(best) > 1
        seen = raked.agg(
            F.count_if(sure).alias("k"), F.sum(F.when(sure, F.col("n"))).alias("n"), F.sum(F.when(~sure, F.col("w"))).alias("w")
        ).first()
        if seen.k == full:
            break
        full = seen.k
        best = (wanted - (seen.n or 0.0)) / seen.w if seen.w else float("inf")
    chance = F.least(F.lit(1.0), ratio * F.lit(best))
    return raked.select(*MARGINALS, F.when(ratio > 0, chance).otherwise(0.0).alias("probability"))


def cell_chances(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    share: float = SHARE,
    temperature: float = TEMPERATURE,
    rounds: int = ROUNDS,
    local_cells: int = LOCAL_CELLS,
    topic: Column | str | None = None,
) -> DataFrame:
    """The table of cells with their probabilities, marked for broadcast where it is small.

    ``targets`` gives shares by value for any of the marginals; a value that is
    not named there gets none.
    """
    cells = cut(_keys(docs, topic=topic).groupBy(*MARGINALS).agg(F.sum("n_tokens").cast("double").alias("n")))
    if cells.count() > local_cells:
        raked = _rake_table(cells, targets, temperature, rounds)
        return cut(_calibrate_table(raked, share * cells.agg(F.sum("n")).first()[0]))
    rows = sorted(cells.collect())
    tokens = np.array([r.n for r in rows], float)
    groups, wanted = [], []
    for m in MARGINALS if rows else ():
        names, group = np.unique([r[m] for r in rows], return_inverse=True)
        if targets and m in targets:
            target = np.array([float(targets[m].get(str(n), 0.0)) for n in names])
        else:
            target = (np.bincount(group, tokens, len(names)) / tokens.sum()) ** temperature
        groups.append(group)
        wanted.append(target / max(target.sum(), 1e-300))
    chances = calibrate(rake(tokens, groups, wanted, rounds), tokens, share * tokens.sum()) if rows else []
    table = docs.sparkSession.createDataFrame(
        [(*r[:-1], float(p)) for r, p in zip(rows, chances, strict=True)],
        ", ".join(f"{m} string" for m in MARGINALS) + ", probability double",
    )
    return F.broadcast(table)


def probabilities(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, selected`` of every row."""
    return (
        _keys(docs, topic=options.get("topic"))
        .join(cell_chances(docs, **options), list(MARGINALS))
        .select("doc_id", *MARGINALS, "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("selected"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of ``docs``, with all their columns."""
    columns = docs.columns
    whole = F.struct(*[column(c) for c in columns]).alias("_row")
    keyed = _keys(docs, whole, topic=options.get("topic")).select(*MARGINALS, "draw", "_row")
    chosen = keyed.join(cell_chances(docs, **options), list(MARGINALS)).where("draw < probability")
    return chosen.select("_row.*")


def marginals(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, **options
) -> DataFrame:
    """``marginal, value, corpus_share, target_share, sample_share``: how well the expected sample meets each target.

    A share falls short of its target where a cell's documents are all taken, or
    where the targets contradict each other.
    """
    rows = probabilities(docs, targets=targets, temperature=temperature, **options)
    n, expected = F.sum("n_tokens").cast("double"), F.sum(F.col("probability") * F.col("n_tokens"))
    by_cell = cut(rows.groupBy(*MARGINALS).agg(n.alias("n"), expected.alias("e")))
    total = by_cell.agg(F.sum("n").alias("n"), F.sum("e").alias("e")).first()
    out = None
    for m in MARGINALS:
        shares = by_cell.groupBy(F.col(m).alias("value")).agg((F.sum("n") / (total.n or 1.0)).alias("c"), (F.sum("e") / (total.e or 1.0)).alias("e"))
        if targets and m in targets:
            given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], "value string, g double")
            shares = shares.join(given, "value", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
        else:
            shares = shares.withColumn("g", F.pow("c", F.lit(temperature)))
        whole = shares.agg(F.sum("g")).first()[0] or 1.0
        part = shares.select(
            F.lit(m).alias("marginal"), "value", F.col("c").alias("corpus_share"), (F.col("g") / whole).alias("target_share"), F.col("e").alias("sample_share")
        )
        out = part if out is None else out.unionByName(part)
    return out


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probabilities of the whole documents table, with the draws."""
    return probabilities(read(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


def _oracle() -> str:
    """Raking and calibration spelled out, one step a table expression."""
    topic = (
        "CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'blank' WHEN contains(coalesce(text, ''), ' | ') THEN 'table' "
        "WHEN length(coalesce(text, '')) < 400 THEN 'note' WHEN length(coalesce(text, '')) < 4000 THEN 'article' ELSE 'long' END"
    )
    steps = [
        f"""k AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic,
            greatest(1, CAST(ceil(strlen(coalesce(text, '')) / {BYTES_A_TOKEN}.0) AS BIGINT)) AS n_tokens,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '') || ':mix'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
            FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM k GROUP BY ALL)",
    ]
    for m in MARGINALS:
        steps.append(
            f"t_{m} AS MATERIALIZED (SELECT {m}, sqrt(sum(t) / (SELECT sum(t) FROM c)) AS g FROM c GROUP BY {m})"
        )
    steps.append(
        """w0 AS MATERIALIZED (SELECT c.*, t / (SELECT sum(t) FROM c) AS w, a.g / (SELECT sum(g) FROM t_source) AS gs,
        b.g / (SELECT sum(g) FROM t_lang) AS gl, d.g / (SELECT sum(g) FROM t_topic) AS gt
        FROM c JOIN t_source a USING (source) JOIN t_lang b USING (lang) JOIN t_topic d USING (topic))"""
    )
    n = 0
    for _ in range(ROUNDS):
        for m, g in zip(MARGINALS, ("gs", "gl", "gt"), strict=True):
            steps.append(
                f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, t, w * {g} / sum(w) OVER (PARTITION BY {m}) AS w, gs, gl, gt FROM w{n})"
            )
            n += 1
    order = "OVER (ORDER BY w / t DESC, source, lang, topic ROWS BETWEEN"
    steps += [
        f"""p AS MATERIALIZED (SELECT source, lang, topic, w / t AS r, ({SHARE} * (SELECT sum(t) FROM c)
            - coalesce(sum(t) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
            FROM w{n})""",
        "s AS MATERIALIZED (SELECT coalesce(min(scale) FILTER (WHERE r = (SELECT max(r) FROM p WHERE scale * r <= 1)), 1e300) AS best FROM p)",
    ]
    return (
        "WITH "
        + ",\n".join(steps)
        + """ SELECT doc_id, source, lang, topic, n_tokens, round(least(1.0::DOUBLE, r * best), 9) AS probability,
        draw < least(1.0::DOUBLE, r * best) AS selected FROM k JOIN p USING (source, lang, topic), s"""
    )


ORACLE = _oracle()
