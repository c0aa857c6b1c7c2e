"""Header bands, transition signals and plain file names over whole tables, against plain Python."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher
from fractions import Fraction
from pathlib import Path

import pytest

from quirewise.operators import pages as P
from quirewise.queries import QUERIES
from quirewise.sources.tables import pages, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")


def lines_of(text):
    return [x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")]


def records(spark):
    found = defaultdict(dict)
    for r in pages(spark, SF).collect():
        found[r.doc_id][r.page] = r.text
    return found


def test_band_change(spark):
    def band(text):
        every = lines_of(text)
        ends = " ".join([*every[:3], *every[max(0, len(every) - 3) :]]).lower()
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"[^a-z\s]", " ", ends, flags=re.ASCII)).strip(" ")

    want = set()
    for doc, texts in records(spark).items():
        want.add((doc, 1))
        for page in sorted(texts)[1:]:
            a, b = band(texts[page - 1]), band(texts[page])
            if a and b and SequenceMatcher(None, a, b).ratio() < 0.45:
                want.add((doc, page))
    assert {tuple(r) for r in QUERIES["band_change"](spark, SF).collect()} == want and len(want) > 200


def test_transition_signals(spark):
    letters = lambda t: re.sub(r"[\d\W]+", " ", t.lower()).strip(" ")
    mark = re.compile(r"fax|facsimile|transmi|([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\D{0,10}[0-9]{1,2}:[0-9]{2})", re.I)

    def facts(text):
        counter = re.search(r"page\s{0,2}([0-9]{1,3})\s{0,2}(?:of|/)\s{0,2}([0-9]{1,4})", text[:2000], re.I)
        top = lines_of(text)[:3]
        flagged = next((x for x in top if mark.search(x)), None)
        dates = {m[0] for m in re.finditer(r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", text)}
        return counter and tuple(map(int, counter.groups())), dates, len(text.encode()), letters(" ".join(top)), None if flagged is None else letters(flagged)

    want = {}
    for doc, texts in records(spark).items():
        said = {}
        for page, text in texts.items():
            n = len(text)
            said[page] = facts(text + ("" if n % 3 == 0 else f" Page {page % 4 + 1} of {3 + n % 2} copies"))
        for page in sorted(said)[1:]:
            (counter, dates, size, head, flag), (_, dates0, size0, head0, flag0) = said[page], said[page - 1]
            number = 0 if not counter or counter[0] < 1 or counter[1] < counter[0] else 1 if counter[0] == 1 else -1
            date = -1 if dates & dates0 else 1 if dates and dates0 else 0
            alike = SequenceMatcher(None, head, head0).ratio()
            header = 0 if not head or not head0 else -1 if alike >= 0.75 else 1 if alike <= 0.35 else 0
            banner = 0 if not flag or not flag0 else -1 if SequenceMatcher(None, flag, flag0).ratio() >= 0.7 else 1
            want[doc, page] = number, banner, header, date, int(abs(size - size0) / max(size, size0, 1) >= 0.5)
    got = {(r.doc_id, r.page): (r.pagenum, r.banner, r.header, r.dates, r.bytes) for r in QUERIES["transition_signals"](spark, SF).collect()}
    assert got == want and {x[0] for x in want.values()} == {-1, 0, 1} and {x[2] for x in want.values()} == {-1, 0, 1}


def test_safe_names(spark):
    def plain(text):
        flat = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
        kept = re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(re.sub(r"[/\\]", " ", flat).split()))
        return kept.strip("._") or "file"

    want = sorted((r.doc_id, plain(r.text)) for r in table(spark, SF, "documents").collect())
    assert sorted(map(tuple, QUERIES["safe_names"](spark, SF).select("doc_id", "name").collect())) == want


def picture_bits(text):
    """The hash by plain fractions: lines of 72 characters as a picture, 8 x 9 area averages, left brighter than right."""
    rows = [[int(c > " ") for c in text[i : i + 72].ljust(72)] for i in range(0, max(len(text), 1), 72)]
    cell = lambda r, c: sum(
        max(Fraction(0), min(Fraction((r + 1) * len(rows), 8), y + 1) - max(Fraction(r * len(rows), 8), y)) * sum(row[8 * c : 8 * c + 8]) for y, row in enumerate(rows)
    )
    grid = [[cell(r, c) for c in range(9)] for r in range(8)]
    return [grid[r][c] < grid[r][c + 1] for r in range(8) for c in range(8)]


def test_transition_pictures(spark):
    """All six signals: the pictures of two pages, too."""
    want = {}
    some = [d for d in sorted(records(spark)) if d % 4 == 0]
    for doc, texts in records(spark).items():
        if doc in some:
            marked = {p: t + ("" if len(t) % 3 == 0 else f" Page {p % 4 + 1} of {3 + len(t) % 2} copies") for p, t in texts.items()}
            bits = {p: picture_bits(t) for p, t in marked.items()}
            for page in sorted(bits)[1:]:
                apart = sum(a != b for a, b in zip(bits[page], bits[page - 1], strict=True))
                want[doc, page] = -1 if apart <= 8 else 1 if apart >= 24 else 0
    got = {(r.doc_id, r.page): r.phash for r in QUERIES["transition_signals"](spark, SF).collect() if r.doc_id in some}
    assert got == want and set(want.values()) == {-1, 0, 1}


def test_pictures_that_pages_bring(spark):
    rows = [(1, p, "x", h) for p, h in enumerate([0, 255, 511, (1 << 24) - 1, -1, None, 3], start=1)]
    got = P.transition_signals(spark.createDataFrame(rows, "doc_id long, page int, text string, hash long")).orderBy("page").collect()
    assert [r.phash for r in got] == [-1, -1, 0, 1, 0, 0]
    long = spark.createDataFrame([(1, 1, "a b " * 600), (1, 2, ""), (1, 3, None)], "doc_id long, page int, text string")
    by_part = [[r.hash for r in P.page_hashes(long, n).orderBy("page").collect()] for n in (1, 2400, 10**6)]
    assert by_part[0] == by_part[1] == by_part[2] and by_part[0][1:] == [0, 0]
