"""The whole duplicate review over a table, against plain Python over all pairs."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from pathlib import Path

import pytest

from quirewise.operators import dedup as U
from quirewise.plans.duplicates import review_rows
from quirewise.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, verdicts):
    """(group, similarity, dismissed) by key."""
    masked = {r.doc_id: re.sub(r"\b[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}\b", "DATEMASK", r.text or "") for r in rows}
    words = {i: set(re.findall("[a-z0-9]{2,}", t.lower())) for i, t in masked.items()}
    known = lambda x: "" if (x or "").strip().lower() in ("", "-") else x.strip().lower()
    by = {r.doc_id: r for r in rows}
    group = {i: i for i in by}
    ids = sorted(by)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if known(by[a].date) == known(by[b].date) and words[a] and words[b] and len(words[a] & words[b]) >= 0.7 * len(words[a] | words[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    said = {v.doc_id: v for v in verdicts}
    groups, out = {}, {i: (None, None, False) for i in ids}
    for i in ids:
        groups.setdefault(group[i], []).append(i)
    n = 0
    for members in groups.values():
        if len(members) < 2:
            continue
        cut = [masked[i][:1500] for i in members]
        least = min((SequenceMatcher(None, x, y).ratio() for k, x in enumerate(cut) for y in cut[k + 1 :] if x != y), default=1.0)
        least = round(least, 3)
        one = lambda c: len({known(getattr(by[i], c)) for i in members}) == 1 and known(getattr(by[members[0]], c)) != ""  # noqa: B023, E731
        if not (one("date") and (one("title") or one("category")) or least >= 0.95):
            continue
        kept = [i for i in members if least >= 0.95 or i in said and (said[i].failed or said[i].same)]
        if len(kept) >= 2:
            n += 1
            out |= {i: (n, least, False) for i in kept}
    return out


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")
def test_duplicate_review(spark):
    rows, verdicts = review_rows(spark, SF)
    want = plain(rows.collect(), verdicts.collect())
    got = {r.doc_id: (r.dupe_group, r.dupe_similarity, r.dupe_dismissed) for r in QUERIES["duplicate_review"](spark, SF).collect()}
    assert got == want and max(x[0] or 0 for x in want.values()) > 3


def test_review_of_nothing(spark):
    kinds = "doc_id long, text string, date string, title string, category string, dupe_group long, dupe_similarity double, dupe_dismissed boolean"
    none = spark.createDataFrame([], "doc_id long, same boolean, failed boolean")
    assert U.reviewed(spark.createDataFrame([], kinds), none, "doc_id", "doc_id").count() == 0
    alone = spark.createDataFrame([(1, None, None, None, None, 3, 0.9, True), (2, "some words", "-", "t", "c", 3, 0.9, True)], kinds)
    got = U.reviewed(alone, none, "doc_id", "doc_id").collect()
    assert [tuple(r)[5:] for r in sorted(got)] == [(None, None, False)] * 2
