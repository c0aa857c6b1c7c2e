"""Dates as texts: ``MM/DD/YYYY``, with ``-`` for a document that states none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "unknown" where duplicates are compared; fixed values.
UNKNOWN = ("", "-", "n/a", "none", "unknown")
FIRST_DAY = "0001-01-01"
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)


def parse(text: Column) -> Column:
    """The date of ``M/d/yyyy``, or null."""
    return F.try_to_date(F.trim(text), "M/d/yyyy")


def is_valid(text: Column) -> Column:
    """Whether a date text is acceptable: ``-`` or a real day."""
    return F.coalesce((F.trim(text) == "-") | parse(text).isNotNull(), F.lit(False))


def parse_or_first(text: Column) -> Column:
    """The date, or the first day where there is none: undated entries come first."""
    return F.coalesce(parse(text), F.to_date(F.lit(FIRST_DAY)))


def normalise(month: Column, day: Column, year: Column) -> Column:
    """``MM/DD/YYYY`` of three texts of digits, or null beyond the ranges; no calendar check."""
    m, d, y = (x.try_cast("int") for x in (month, day, year))
    full = F.when(y < 100, y + 2000).otherwise(y)
    return F.when(
        m.between(1, 12) & d.between(1, 31) & full.between(1900, 2100),
        F.format_string("%02d/%02d/%04d", m, d, full),
    )


def house_date(token: Column) -> Column:
    """``MM/DD/YY`` of one date token with any separators."""
    part = F.split(token, r"[/.\-]")
    return F.concat(
        F.lpad(part[0].cast("int").cast("string"), 2, "0"),
        F.lit("/"),
        F.lpad(part[1].cast("int").cast("string"), 2, "0"),
        F.lit("/"),
        F.substring(part[2], -2, 2),
    )


def sort_key(text: Column) -> Column:
    """(unknown, year, month, day) for listings with unknown dates last; two-digit years are of this century."""
    part = F.split(F.trim(text), "/")
    number = [F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    year = F.when(number[2] < 100, number[2] + 2000).otherwise(number[2])
    known = (F.size(part) == 3) & number[0].isNotNull() & number[1].isNotNull() & number[2].isNotNull()
    return F.struct(
        F.coalesce(~known, F.lit(True)).alias("unknown"),
        F.when(known, year).alias("year"),
        F.when(known, number[0]).alias("month"),
        F.when(known, number[1]).alias("day"),
    )


def loose_pattern(date: Column) -> Column:
    """A pattern for an ``MM/DD/YYYY`` date with any separators and short years."""
    m, d, y = (F.get(F.split(date, "/"), F.lit(i)) for i in range(3))
    bare = [F.regexp_replace(x, "^0+(?=.)", "") for x in (m, d)]
    sep = F.lit(r"\s?[/.-]\s?")
    year = F.concat(F.lit("("), y, F.lit("|"), F.substring(y, -2, 2), F.lit(")"))
    return F.concat(F.lit("(^|[^0-9])0?"), bare[0], sep, F.lit("0?"), bare[1], sep, year, F.lit("([^0-9]|$)"))


def month_pattern(date: Column) -> Column:
    """The loose pattern with any day."""
    m, y = (F.get(F.split(date, "/"), F.lit(i)) for i in (0, 2))
    sep = F.lit(r"\s?[/.-]\s?")
    year = F.concat(F.lit("("), y, F.lit("|"), F.substring(y, -2, 2), F.lit(")"))
    bare = F.regexp_replace(m, "^0+(?=.)", "")
    return F.concat(F.lit("(^|[^0-9])0?"), bare, sep, F.lit("[0-9]{1,2}"), sep, year, F.lit("([^0-9]|$)"))


def spelled_pattern(date: Column) -> Column:
    """A pattern for ``March 11, 2026``, in any case."""
    m, d, y = (F.get(F.split(date, "/"), F.lit(i)) for i in range(3))
    names = F.array(*[F.lit(x) for x in MONTHS])
    return F.concat(
        F.lit("(?i)"), F.get(names, m.try_cast("int") - 1), F.lit(r"\s+0?"), F.regexp_replace(d, "^0+(?=.)", ""), F.lit(r",?\s+"), y
    )


def is_checkable(date: Column) -> Column:
    """Whether a date text is a full ``MM/DD/YYYY`` that can be looked for."""
    shape = date.rlike(r"^[0-9]+/[0-9]+/[0-9]{4}$")
    part = [F.get(F.split(date, "/"), F.lit(i)).try_cast("int") for i in (0, 1)]
    return F.coalesce(shape & part[0].between(1, 12) & part[1].between(1, 31), F.lit(False))


def appears(date: Column, text: Column) -> Column:
    """Whether a date is written in a text, with loose separators or spelled out."""
    return F.coalesce(F.rlike(text, loose_pattern(date)) | F.rlike(text, spelled_pattern(date)), F.lit(False))


#: Spellings of date labels, by family, in order of what they tell; fixed values.
DATE_LABELS = {
    "encounter_date": (
        r"date of exam(?:ination)?", r"exam(?:ination)? date", r"date of visit", r"visit date", r"date of service",
        r"\bd\.?o\.?s\.?\b", r"date of encounter", r"encounter date", r"date seen", r"service date",
    ),
    "signature_date": (
        r"signature date", r"date signed", r"signed on", r"electronically signed(?:\s+by[^0-9\n]{0,40})?", r"e-?signed",
    ),
    "print_or_fax_date": (
        r"printed on", r"print date", r"date printed", r"fax(?:ed)? date", r"date faxed", r"received date", r"date received",
    ),
    "date_of_injury": (r"date of injury", r"\bd\.?o\.?i\.?\b", r"injury date"),
}
LABEL_GAP = r"[^0-9\n]{0,24}"
LABELLED = r"(\d{1,2})\s?[/.-]\s?(\d{1,2})\s?[/.-]\s?(\d{2,4})"


def labelled_dates(text: Column, family: str) -> Column:
    """Distinct normalised dates that stand next to a label of the family."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for label in DATE_LABELS[family]:
        pattern = F.lit(label + LABEL_GAP + LABELLED)
        # Texts are searched once; the pieces are those of the short matches.
        matches = F.regexp_extract_all(low, pattern, F.lit(0))
        found.append(F.transform(matches, lambda x: normalise(*[F.regexp_extract(x, LABELLED, i) for i in (1, 2, 3)])))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x.isNotNull()))


def appears_loosely(date: Column, text: Column) -> Column:
    """Whether a date is written in a text with any separators or blanks, or spelled out with an ordinal; bad dates are not."""
    part = [F.try_element_at(F.split(date, "/"), F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    m, d, y = (p.cast("string") for p in part)
    sep = F.lit(r"[/\-.\s]{1,3}")
    numeric = F.concat(F.lit(r"\b0?"), m, sep, F.lit("0?"), d, sep, F.lit("("), y, F.lit("|"), F.substring(y, 3, 2), F.lit(r")\b"))
    names = F.array(*[F.lit(x) for x in MONTHS])
    spelled = F.concat(F.lit(r"(?i)\b"), F.get(names, part[0] - 1), F.lit(r"\.?\s+0?"), d, F.lit(r"(st|nd|rd|th)?,?\s+"), y, F.lit(r"\b"))
    return F.coalesce(F.rlike(text, numeric) | F.rlike(text, spelled), F.lit(False))
