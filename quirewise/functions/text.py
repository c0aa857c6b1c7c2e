"""Scalar text functions, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import UNKNOWN, house_date

#: Characters of a text that are compared character by character; a fixed value.
EXCERPT = 1500
#: What a date looks like; a fixed value.
DATE_TOKEN = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b"


def mask_dates(text: Column) -> Column:
    """Date-shaped tokens replaced, so two copies differ only in what they say."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), DATE_TOKEN, "DATEMASK")


def signature(text: Column) -> Column:
    """The set of lower-case words of two and more letters or digits, dates masked."""
    return F.array_distinct(F.regexp_extract_all(F.lower(mask_dates(text)), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets, 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def comparison_key(text: Column) -> Column:
    """Lower case with single blanks; the words for "unknown" become the empty text."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.when(key.isin(*UNKNOWN), "").otherwise(key)


def fingerprint(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-256 of parts that each end in NUL (null: empty)."""
    ended = [F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts]
    return F.substring(F.sha2(F.concat(*ended), 256), 1, 12)


def bold_spans(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\*\*(.+?)\*\*"))


def filled_lines(text: Column) -> Column:
    """How many lines of a text are not blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


def drops_headings(raw: Column, fixed: Column, issue_types: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a fix that claims only ``allowed`` issues lost bold headings."""
    only = (F.size(issue_types) > 0) & (F.size(F.array_except(issue_types, F.array(*[F.lit(a) for a in allowed]))) == 0)
    return only & (bold_spans(fixed) < bold_spans(raw))


def drops_structure(raw: Column, fixed: Column) -> Column:
    """Whether a fix lost lines or openers ``On pages a to b``."""
    openers = lambda x: F.regexp_count(x, F.lit(r"(?im)^\s*on pages? \d+ to \d+"))
    return (filled_lines(fixed) < filled_lines(raw)) | (openers(fixed) < openers(raw))


def usable_title(made: Column, fallback: Column, most: int = 200) -> Column:
    """A title of 1 to ``most`` characters, else the fallback, else ``-``."""
    good = lambda x: F.when(F.length(F.trim(x)).between(1, most), F.trim(x))
    return F.coalesce(good(made), good(fallback), F.lit("-"))


def page_counter(text: Column, broad: bool = False) -> Column:
    """``struct<x, y>`` of the last counter ``page X of Y`` with X <= Y on a page.

    ``broad`` also takes a bare ``X of Y`` where there is none of the first kind.
    """

    def last(pattern: str) -> Column:
        xs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        ys = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        pairs = F.transform(
            F.arrays_zip(xs.alias("x"), ys.alias("y")),
            lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")),
        )
        return F.try_element_at(F.filter(pairs, lambda p: p["x"] <= p["y"]), F.lit(-1))

    # Printed forms of counters; fixed values.
    strict = last(r"(?i)page\s+(\d{1,4})\s+of\s+(\d{1,4})")
    return F.coalesce(strict, last(r"(?i)(?<!\d)(\d{1,4})\s+of\s+(\d{1,4})(?!\d)")) if broad else strict


def filled(text: Column) -> Column:
    """The trimmed lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def band(text: Column, lines: int = 3) -> Column:
    """Letters of the first and last lines of a page; short pages repeat theirs."""
    every = filled(text)
    ends = F.concat(F.slice(every, 1, lines), F.slice(every, F.greatest(F.size(every) - lines + 1, F.lit(1)), lines))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.array_join(ends, " ")), r"[^a-z\s]", " "), r"\s+", " "))


def heading(text: Column, lines: int = 3) -> Column:
    """Letters of the first lines of a page."""
    top = F.array_join(F.slice(filled(text), 1, lines), " ")
    return F.trim(F.regexp_replace(F.lower(top), r"(?U)[\d\W]+", " "))


def banner(text: Column) -> Column:
    """The first of the top lines that looks like a fax banner, without digits and signs."""
    # What marks a fax banner; a fixed value.
    pattern = r"(?i)fax|facsimile|transmi|(\d{1,2}/\d{1,2}/\d{2,4}\D{0,10}\d{1,2}:\d{2})"
    line = F.try_element_at(F.filter(F.slice(filled(text), 1, 3), lambda x: x.rlike(pattern)), F.lit(1))
    return F.trim(F.regexp_replace(F.lower(line), r"(?U)[\d\W]+", " "))


def date_tokens(text: Column) -> Column:
    """The distinct slash dates of a page."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"), F.lit(0)))


#: Forms of dates, periods and injury-date prefixes that texts must match; fixed values.
_D = r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
_DS = r"\d{1,2}[/.]\d{1,2}[/.]\d{2,4}"
_ITEM = rf"(?i)(\bC\.?T\.?\s*:?\s*)?({_DS})\s*(?:-|--|to|through)\s*({_DS})|({_D})"
_ONE = rf"(?:CT\s*)?{_DS}\s*-\s*{_DS}|{_D}"
_PREFIX = rf"(?i)^\s*\*\*DOI\*\*:\s*((?:{_ONE})(?:\s*&\s*(?:{_ONE}))*)\s*\.\s*"
_OLD_PREFIX = r"^\s*(\*\*DOI\*\*:\s*\d[\d/.\-]*(?:\s*,\s*\d[\d/.\-]*)*)\s*,\s*"


def injury_dates(reply: Column) -> Column:
    """The injury dates and periods a reply states, in house format; ``-`` for none.

    Periods are tried before single dates and keep a stated ``CT`` mark.
    """
    text = F.coalesce(reply, F.lit(""))
    group = [F.regexp_extract_all(text, F.lit(_ITEM), F.lit(i)) for i in (1, 2, 3, 4)]
    items = F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(group, ("ct", "a", "b", "one"), strict=True)]),
        lambda x: F.when(x["one"] != "", house_date(x["one"])).otherwise(
            F.concat(F.when(F.trim(x["ct"]) != "", "CT ").otherwise(""), house_date(x["a"]), F.lit("-"), house_date(x["b"]))
        ),
    )
    joined = F.array_join(F.array_distinct(items), " & ")
    return F.when(joined == "", "-").otherwise(joined)


def injury_prefix(body: Column) -> Column:
    """The leading injury prefix of a body as it is stored, in the house or the older form."""
    text = F.coalesce(body, F.lit(""))
    new, old = F.regexp_extract(text, _PREFIX, 1), F.regexp_extract(text, _OLD_PREFIX, 1)
    return F.when(new != "", F.concat(F.lit("**DOI**: "), new, F.lit("."))).when(old != "", F.concat(old, F.lit(","))).otherwise("")


def with_injury_prefix(body: Column, injury: Column) -> Column:
    """The body with its injury prefix rewritten; none where the injury is ``-``."""
    new = F.regexp_replace(body, _PREFIX, "")
    bare = F.when(new == body, F.regexp_replace(body, _OLD_PREFIX, "")).otherwise(new)
    stated = F.coalesce((injury != "") & (injury != "-"), F.lit(False))
    made = F.when(stated, F.concat(F.lit("**DOI**: "), injury, F.lit(". "), bare)).otherwise(bare)
    return F.when(body.isNull() | (body == ""), body).otherwise(made)


def export_title(title: Column) -> Column:
    """A title without review marks and page suffix."""
    bare = F.regexp_replace(F.trim(title), r"^\[ManualCheck\]\s*", "")
    bare = F.rtrim(F.regexp_replace(bare, r"(?i)\(pages\s+\d+\s*[-–]\s*\d+\)\s*$", ""))
    return F.trim(F.regexp_replace(bare, r"\s*\[Diagnostic Study\]\s*", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_name(text: Column, fallback: str = "file") -> Column:
    """A text as a safe file name."""
    name = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^[_.]+|[_.]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def to_html(text: Column) -> Column:
    """Inline emphasis marks as HTML."""
    bold = F.regexp_replace(text, r"\*\*(.+?)\*\*", "<b>$1</b>")
    return F.regexp_replace(F.regexp_replace(bold, r"\*(.+?)\*", "<i>$1</i>"), r"(?<![A-Za-z0-9])_(.+?)_(?![A-Za-z0-9])", "<i>$1</i>")


def seconds(text: Column) -> Column:
    """The seconds of a duration such as ``17s`` or ``1.5s``."""
    return F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)?)s$", 1).try_cast("double")


def token_estimate(chars: Column, images: Column | int = 0, files: Column | int = 0) -> Column:
    """Estimated tokens of a request: characters by four, and allowances by attachment."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.lit(1), F.floor(chars / 4) + 258 * lit(images) + 258 * lit(files)).cast("bigint")


def page_phrase(pages: Column) -> Column:
    """``page 7`` or ``pages 7, 8 and 11``."""
    numbers = F.transform(F.array_sort(F.array_distinct(pages)), lambda x: x.cast("string"))
    n = F.size(numbers)
    several = F.concat(
        F.lit("pages "), F.array_join(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(numbers, F.lit(-1))
    )
    return F.when(n == 0, "").when(n == 1, F.concat(F.lit("page "), F.try_element_at(numbers, F.lit(1)))).otherwise(several)


def display_parts(title: Column, body: Column) -> list[Column]:
    """``title, injury, body`` as a summary is shown: without marks, the injury dates apart (null for none)."""
    shown = F.regexp_replace(title, r"(?i)^\s*\[ManualCheck\]\s*", "")
    shown = F.regexp_replace(shown, r"(?i)\s*\(Pages\s+\d+\s*[-–]\s*\d+\)\s*$", "")
    shown = F.regexp_replace(shown, r"(?i)\s*\[Diagnostic Study\]\s*$", "")
    text = F.coalesce(body, F.lit(""))
    new = F.regexp_extract(text, _PREFIX, 1)
    old = F.regexp_replace(F.regexp_extract(text, _OLD_PREFIX, 1), r"^\*\*DOI\*\*:\s*", "")
    injury = F.nullif(F.trim(F.when(new != "", new).otherwise(old)), F.lit(""))
    rest = F.when(new != "", F.regexp_replace(text, _PREFIX, "")).otherwise(F.regexp_replace(text, _OLD_PREFIX, ""))
    return [F.coalesce(shown, F.lit("")).alias("title"), injury.alias("injury"), rest.alias("body")]


def title_key(title: Column) -> Column:
    """Letters, digits and blanks of a title, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("Unknown")), r"[^a-zA-Z0-9\s]", "")))
