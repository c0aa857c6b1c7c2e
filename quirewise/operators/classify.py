"""The classification cascade: ordered rules, nearest vector, external vote, fusion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as X
from quirewise.session import ship

#: Categories of a catalog of vectors, at most.
CATEGORIES = 2_000
#: The category of paperwork, and of whatever nothing else claims.
GENERAL = "100"
#: A mere mention of the evaluator gives this; it yields to any of the others.
EVALUATOR, STRONGER = "13", ("3", "8", "9", "14")

#: Titles of paperwork around documents.
PAPERWORK = (
    r"routing (sheet|slip|form)|records? routing",
    r"\b(cover|transmittal) letter\b|\b(ame|qme|pqme) letter\b|\bcorrespondence\b|^\s*e-?mail\s*$",
    r"^declaration\b|\bdeclaration of service\b|proof of service|certificate of (service|mailing)|declaration under penalty",
    r"schedule of records|index of records|records? (request|index)|request for (medical )?records",
    r"\b(request|notice|scheduling) (for |of |to )?[\w\s-]{0,24}\b(evaluation|examination)\b|\b(evaluation|examination) (request|notice|appointment)\b",
    r"\bfacesheet\b|\bflowsheets?\b|\bafter visit summary\b|\bcoding summary\b|\bpatient (referral|signature page|information sheet)\b"
    r"|\b(er|emergency room) registration\b|\bconditions of admission\b|\b(admission|inpatient|emergency patient) record\b"
    r"|\bmedication administration\b|\bed care timeline\b",
)
#: Document types in order of precedence, each with its category.
RULES = (
    (r"supplement\w*.{0,40}\b(qme|ame|pqme)\b|\b(qme|ame|pqme)\b.{0,40}supplement", "12"),
    (r"\b(qme|ame|pqme)\b|qualified medical evaluator|agreed medical evaluator", "13"),
    (r"utilization review|independent medical review|\bimr\b", "15"),
    (r"return[- ]to[- ]work\b.{0,40}\bvoucher\b|\bvoucher\b.{0,40}return[- ]to[- ]work", "1"),
    (
        r"physical therapy|chiropractic|chiropractor|acupuncture|\bpt\b initial|pt progress"
        r"|shock[- ]?wave (therapy|treatment)|functional improvement",
        "5",
    ),
    (
        r"\bpr-?4\b|permanent and stationary|\bp ?& ?s\b|maximum medical improvement|\bmmi\b"
        r"|doctor'?s first report|\bdfr\b|initial.{0,20}consultation",
        "2",
    ),
    (r"\bpr-?2\b|progress report|progress note|office visit|follow ?-? ?up", "1"),
    (
        r"\bmri\b|\bct\b|ct scan|x-? ?ray|\bemg\b|\bncs\b|diagnostic study|mammogram|sleep study|colonoscopy|dexa|ultrasound|radiolog",
        "3",
    ),
    (r"operative report|surgical patholog|patholog|operation performed|oversight physician", "8"),
    (r"deposition", "9"),
    (r"\brfa\b|request for authorization", "10"),
    (r"adjudication of claim|application for adjudication|compensation claim|\bdwc-? ?1\b", "7"),
    (r"comprehensive interval history|medical decision making", "11"),
    (r"gi outpatient|outpatient procedure h ?& ?p", "4"),
    (r"lab(oratory)? results|test results", "14"),
)
DOCUMENT_NOUN = r"\b(report|transcript|notes?|study|scan|imaging|x-? ?ray|chart|questionnaire|results?)\b"
ABOUT_A_DOCUMENT = r"\b(declaration|proof|certificate) of (service|mailing) of\b"


def by_rules(title: Column) -> Column:
    """The category that a title's wording decides, or null.

    Paperwork is general unless another type than the evaluator's is named too;
    a title that names a document is judged as one.
    """
    text = F.lower(F.coalesce(title, F.lit("")))
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(c)) for p, c in RULES]))
    strong = F.arrays_overlap(found, F.array(*[F.lit(c) for c in STRONGER]))
    kept = F.when(strong, F.array_remove(found, EVALUATOR)).otherwise(found)
    paperwork = F.lit(False)
    for pattern in PAPERWORK:
        paperwork = paperwork | text.rlike(pattern)
    document = text.rlike(DOCUMENT_NOUN) & ~text.rlike(ABOUT_A_DOCUMENT)
    first = F.try_element_at(kept, F.lit(1))
    wrapped = F.coalesce(F.try_element_at(F.array_remove(kept, EVALUATOR), F.lit(1)), F.lit(GENERAL))
    return F.when(~paperwork | document, first).otherwise(wrapped)


def nearest_category(vectors: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """``key, category, similarity`` of the category vector with the largest dot product.

    ``categories`` gives ``category, vector`` and is a catalog of at most
    ``CATEGORIES`` rows (more are an error), which every task gets; rows are rated
    where they are, without a shuffle.  Ties go to the first by name.
    """
    if (n := categories.limit(CATEGORIES + 1).count()) > CATEGORIES:
        raise ValueError(f"more than {CATEGORIES} categories")
    if not n:
        return vectors.limit(0).select(key, F.lit(None).cast(categories.schema["category"].dataType).alias("category"), F.lit(0.0).alias("similarity"))
    catalog = categories.agg(F.sort_array(F.collect_list(F.struct("category", "vector"))).alias("_all"))  # one row, of checked size
    dot = lambda v: F.aggregate(F.zip_with("embedding", v, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    rated = F.transform("_all", lambda c, i: F.struct(dot(c["vector"]).alias("s"), (-i).alias("o"), c["category"].alias("c")))
    best = vectors.crossJoin(F.broadcast(catalog)).select(key, F.array_max(rated).alias("_b"))
    return best.select(key, F.col("_b.c").alias("category"), F.col("_b.s").alias("similarity"))


def fuse(rule: Column, vector: Column, vote: Column) -> Column:
    """``struct<category, confidence, method, needs_review>`` of three nullable opinions."""

    def made(category: Column, confidence: str, method: str, review: bool) -> Column:
        return F.struct(
            category.alias("category"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), F.lit(review).alias("needs_review")
        )

    return (
        F.when(rule.isNotNull(), made(rule, "high", "rules", False))
        .when(vector.isNull() & vote.isNull(), made(F.lit(GENERAL), "low", "default", True))
        .when(vote.isNull(), made(vector, "low", "embedding", True))
        .when(vector.isNull(), made(vote, "low", "vote", True))
        .when(vector == vote, made(vote, "high", "agreement", False))
        .otherwise(made(vote, "low", "vote", True))
    )


def escalated(rows: DataFrame, texts: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Opinions on rows, those in doubt asked a second time with the text of their pages.

    ``rows`` gives ``key, category, confidence, method, needs_review, flag``;
    ``texts`` ``key, text``; ``again`` the same columns as ``rows`` without the
    flag, of the second asking.  Only rows in doubt meet their text; where it is
    blank or the asking failed (no row), the first opinion stays.  A row that is
    still in doubt, or was flagged, gets the flag ``x``.
    """
    opinion = ["category", "confidence", "method", "needs_review"]
    doubt = F.coalesce("needs_review", F.lit(True))
    second = again.select(key, F.struct(*opinion).alias("_second"))
    readable = texts.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "").select(key).distinct()
    asked = rows.where(doubt).join(readable, key, "left_semi").join(second, key)
    told = asked.select(key, "flag", "_second.*").unionByName(rows.join(asked.select(key), key, "left_anti").select(key, "flag", *opinion))
    flagged = F.coalesce("needs_review", F.lit(True)) | (F.lower(F.trim(F.coalesce("flag", F.lit("")))) == "x")
    return told.withColumn("flag", F.when(flagged, "x").otherwise(F.col("flag")))


def buckets(title: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first bucket whose pattern a title matches, else ``other``."""
    text, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def resolve_prompts(wanted: DataFrame, custom: DataFrame, builtin: DataFrame) -> DataFrame:
    """The prompt of each ``role, category``: custom, built in, then those of the general category."""
    rows = wanted
    for name, source in (("a", custom), ("b", builtin)):
        rows = rows.join(source.select("role", "category", F.col("text").alias(f"_{name}1")), ["role", "category"], "left")
    for name, source in (("a", custom), ("b", builtin)):
        general = source.where(F.col("category") == GENERAL).select("role", F.col("text").alias(f"_{name}2"))
        rows = rows.join(general, "role", "left")
    return rows.select(*wanted.columns, F.coalesce("_a1", "_b1", "_a2", "_b2").alias("prompt"))


def best_threshold(rows: DataFrame, grid: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """``threshold, f1`` of every threshold, with the first best one marked."""
    tried = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in grid])))
    hit = F.col(score) >= F.col("threshold")
    counted = tried.groupBy("threshold").agg(
        F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn")
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    rated = counted.withColumn("f1", f1)
    place = F.row_number().over(Window.orderBy(F.col("f1").desc(), "threshold"))  # as many rows as the grid has
    return rated.withColumn("best", place == 1)


#: Exemplars that are sent to every task, at most.
EXEMPLARS = 10_000


def fuzzy_category(titles: DataFrame, exemplars: DataFrame, key: str, least: float = 0.65) -> DataFrame:
    """``key, category`` by the exemplar title most like each title, by characters; the general one where none is like enough.

    ``exemplars`` gives ``category, title, place`` and is a catalog of at most
    ``EXEMPLARS`` rows (more are an error); the first by place of equally good
    ones wins.  Equal titles are compared once.
    """
    rows = exemplars.select("place", "category", X.title_key(F.col("title")).alias("t")).orderBy("place").limit(EXEMPLARS + 1).collect()
    if len(rows) > EXEMPLARS:
        raise ValueError(f"more than {EXEMPLARS} exemplars")
    ship(titles.sparkSession)
    named = [(r.category, r.t) for r in rows]
    keyed = titles.select(key, X.title_key(F.col("title")).alias("_t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for title in batch.column(0).to_pylist():
                best, category, match = 0.0, GENERAL, SequenceMatcher(None, title, "")
                for name, example in named:
                    short, long = sorted((len(title), len(example)))
                    bound = 2.0 * short / (short + long) if long else 1.0
                    if bound < least or bound <= best:
                        continue
                    match.set_seq2(example)
                    ratio = match.ratio()
                    if ratio > best and ratio >= least:
                        best, category = ratio, name
                found.append(category)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["_t", "category"])

    rated = keyed.select("_t").distinct().mapInArrow(run, "_t string, category string")
    return keyed.join(rated, "_t").select(key, "category")
