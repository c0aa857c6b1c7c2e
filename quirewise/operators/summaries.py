"""Summaries of review rows around a table of model replies.

Everything but the model's own words is here: which text is read, what happens
when nothing or not all of it could be read, which model answers, which of the
audit's corrections stand, and how title and body are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions import text as X

#: Issues that justify no structural change.
CORRECTIONS = ("capitalization", "range_of_motion")
#: The wording of notices is fixed.
NOTICE = "Unintelligible: the text recognizer could not read "


def unreadable_notice(pages: Column) -> Column:
    """The body of a row of which nothing could be read."""
    return F.concat(F.lit(NOTICE), X.page_phrase(pages), F.lit(" of this document, so there was no text to summarize."))


def partial_notice(pages: Column) -> Column:
    """The sentence behind a summary of the pages that could be read."""
    return F.concat(F.lit(NOTICE), X.page_phrase(pages), F.lit(" of this document, so that content is not covered by this summary."))


def summarise(rows: DataFrame, replies: DataFrame, key: list[str], model: str, fallback: str) -> DataFrame:
    """``key`` and the summary of every row.

    ``rows`` gives ``key, start, end, category, date, injury_date, flag, title,
    text, unreadable`` (an array of pages); ``replies`` gives ``key, body,
    failed, fallback_body, made_title, fixed, fixed_title, issues, audit_failed``.

    Without text the row says so, and no model is named.  A failed body falls back
    to the second model's.  The audit's body stands only where it has issues and
    loses no headings or page groups; its title on its own.  Null replies of a row
    with text leave an empty body.
    """
    r = rows.join(replies, key, "left")
    some = F.trim(F.coalesce("text", F.lit(""))) != ""
    lost = F.size(F.coalesce("unreadable", F.array().cast("array<int>"))) > 0
    down = F.coalesce("failed", F.lit(False)) & F.col("fallback_body").isNotNull()
    body = F.coalesce(F.when(down, F.col("fallback_body")).otherwise(F.col("body")), F.lit(""))
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    found = F.size(issues) > 0
    keeps = ~X.drops_headings(body, F.coalesce("fixed", F.lit("")), issues, CORRECTIONS) & ~(
        (F.col("category") == "9") & X.drops_structure(body, F.coalesce("fixed", F.lit("")))
    )
    ran = some & ~F.coalesce("audit_failed", F.lit(True))
    title = X.usable_title(F.col("made_title"), F.col("title"))
    manual = F.when(F.col("flag") == "x", "[ManualCheck] ").otherwise("")
    study = F.when(F.col("category") == "3", " [Diagnostic Study]").otherwise("")
    place = F.concat(F.lit(" (Pages "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(")"))
    dressed = lambda t: F.concat(manual, t, study, place)
    injury = F.coalesce("injury_date", F.lit(""))
    lead = F.when(injury.isin("", "-"), "").otherwise(F.concat(F.lit("**DOI**: "), injury, F.lit(". ")))
    tail = F.when(lost, F.concat(F.lit(" "), partial_notice(F.col("unreadable")))).otherwise("")
    whole = lambda b: F.concat(lead, b, tail)
    new_title = F.trim(F.coalesce("fixed_title", F.lit("")))
    empty = F.when(lost, unreadable_notice(F.col("unreadable"))).otherwise("There was no text to summarize.")
    return r.select(
        *key,
        F.col("date").alias("date"),
        F.when(some, dressed(title)).otherwise(dressed(X.usable_title(F.lit(None), F.col("title")))).alias("title"),
        F.when(some, whole(body)).otherwise(empty).alias("text"),
        F.coalesce(ran, F.lit(False)).alias("verified"),
        F.when(ran & found & keeps & F.col("fixed").isNotNull(), whole(F.col("fixed"))).alias("verified_text"),
        F.when(ran & found & (new_title != "") & (new_title != title), dressed(new_title)).alias("verified_title"),
        F.when(some, F.when(down, F.lit(fallback)).otherwise(F.lit(model))).alias("model"),
        F.when(some & down, F.lit(model)).alias("fallback_from"),
        (~some).alias("notice_only"),
    )
