"""Scalar functions on literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirewise.functions import dates as D
from quirewise.functions import pacing as P
from quirewise.functions import text as X
from quirewise.operators.caps import repair
from quirewise.operators.classify import by_rules, fuse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        (None, "-"),
        ("", "-"),
        ("the file says nothing", "-"),
        ("hurt on 7/4/2018 at work", "07/04/18"),
        ("CT: 2/3/2011 - 9/8/2014", "CT 02/03/11-09/08/14"),
        ("C.T. 5/6/07 through 7/8/09, then 9-10-11", "CT 05/06/07-07/08/09 & 09/10/11"),
        ("DISTRICT 2/3/2011 - 9/8/2014", "02/03/11-09/08/14"),
        ("7/4/18; 07/04/2018 once more", "07/04/18"),
        ("07.04.2018", "07/04/18"),
    ],
)
def test_injury_dates(spark, reply, expected):
    assert one(spark, X.injury_dates(F.lit(reply).cast("string"))) == expected


@pytest.mark.parametrize(
    ("body", "prefix"),
    [
        ("**DOI**: 07/04/18. The knee.", "**DOI**: 07/04/18."),
        ("**DOI**: CT 05/06/07-07/08/09 & 09/10/11. The knee.", "**DOI**: CT 05/06/07-07/08/09 & 09/10/11."),
        ("**DOI**: 07/04/18, 08/05/19, The knee.", "**DOI**: 07/04/18, 08/05/19,"),
        ("The knee.", ""),
        (None, ""),
    ],
)
def test_injury_prefix(spark, body, prefix):
    assert one(spark, X.injury_prefix(F.lit(body).cast("string"))) == prefix


def test_injury_prefix_rewritten(spark):
    made = lambda b, i: one(spark, X.with_injury_prefix(F.lit(b).cast("string"), F.lit(i)))
    assert made("**DOI**: 07/04/18. The knee.", "10/11/12") == "**DOI**: 10/11/12. The knee."
    assert made("**DOI**: 07/04/18, The knee.", "-") == "The knee."
    assert made(None, "10/11/12") is None and made("", "10/11/12") == ""


@pytest.mark.parametrize(
    ("text", "broad", "expected"),
    [
        ("Page 1 of 3 ... page 2 of 3", False, (2, 3)),
        ("page 5 of 3", False, None),
        ("2 of 4", False, None),
        ("2 of 4", True, (2, 4)),
        ("12 of 4 and page 1 of 2", True, (1, 2)),
    ],
)
def test_page_counter(spark, text, broad, expected):
    found = one(spark, X.page_counter(F.lit(text), broad))
    assert (tuple(found) if found else None) == expected


def test_dates(spark):
    normal = lambda *p: one(spark, D.normalise(*map(F.lit, p)))
    assert normal("2", "30", "24") == "02/30/2024"
    assert normal("13", "1", "2024") is None and normal("1", "1", "1800") is None
    valid = lambda x: one(spark, D.is_valid(F.lit(x).cast("string")))
    assert [valid(x) for x in ("-", "1/2/2024", "02/30/2024", "01/02/24", None)] == [True, True, False, False, False]
    assert one(spark, D.appears(F.lit("03/11/2026"), F.lit("seen March 11, 2026")))
    assert one(spark, D.appears(F.lit("03/11/2026"), F.lit("on 3 - 11 - 26.")))
    assert not one(spark, D.appears(F.lit("03/11/2026"), F.lit("on 13/11/2026")))


def test_labelled_dates(spark):
    text = F.lit("Date of Exam: 8/21/2020. Electronically signed by Dr. X 08/23/2020. DOI 1/2/19; 5/5/2020 alone")
    found = {k: one(spark, D.labelled_dates(text, k)) for k in D.DATE_LABELS}
    assert found == {
        "encounter_date": ["08/21/2020"], "signature_date": ["08/23/2020"], "print_or_fax_date": [], "date_of_injury": ["01/02/2019"],
    }


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, None),
        ("", ""),
        ("billed by PELICAN BAY STAFFING, LLC. later", "billed by Pelican Bay Staffing, Llc. later"),
        ("Refill KEFLEX after the TSH came back.", "Refill Keflex after the TSH came back."),
        ("Wait: RIGHT ELBOW SWELLING is new", "Wait: Right elbow swelling is new"),
        ("so the RIGHT ELBOW swells", "so the right elbow swells"),
        ("**GRIP STRENGTH** fell", "**Grip strength** fell"),
        ("TSH PSA, CBC", "TSH PSA, CBC"),
        ("ROM/PE of KNEE JOINT", "ROM/PE of knee joint"),
        ("THE KNEE and THE HIP", "The knee and the hip"),
        ("mailed to TESTING.lab and XYZLAB", "mailed to Testing.lab and Xyzlab"),
        ("kind-OFWORD stays, OFWORDs too", "kind-OFWORD stays, OFWORDs too"),
    ],
)
def test_caps(text, expected):
    assert repair(text) == expected


@pytest.mark.parametrize(
    ("title", "category"),
    [
        ("Transmittal letter with the AME report", "13"),
        ("Fax cover letter", "100"),
        ("Letter to the AME, jointly written", "13"),
        ("Deposition of the QME, volume II", "9"),
        ("Supplement by the AME", "12"),
        ("Voucher for return to work", "1"),
        ("Return to work and voucher form", "1"),
        ("A page about nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_rules(spark, title, category):
    assert one(spark, by_rules(F.lit(title).cast("string"))) == category


def test_fusion(spark):
    opinions = [(r, e, v) for r in ("9", None) for e in ("1", None) for v in ("1", "2", None)]
    rows = spark.createDataFrame(opinions, "r string, e string, v string")
    got = {(x.r, x.e, x.v): tuple(x.o) for x in rows.select("r", "e", "v", fuse(F.col("r"), F.col("e"), F.col("v")).alias("o")).collect()}
    assert got["9", None, "2"] == ("9", "high", "rules", False)
    assert got[None, None, None] == ("100", "low", "default", True)
    assert got[None, "1", "1"] == ("1", "high", "agreement", False)
    assert got[None, "1", "2"] == ("2", "low", "vote", True)
    assert got[None, "1", None] == ("1", "low", "embedding", True)


def test_small_texts(spark):
    assert one(spark, X.page_phrase(F.array(*map(F.lit, (11, 7, 8, 7))))) == "pages 7, 8 and 11"
    assert one(spark, X.fingerprint(F.lit("a"), F.lit(None).cast("string"))) == one(spark, X.fingerprint(F.lit("a"), F.lit("")))
    assert one(spark, X.export_title(F.lit("[ManualCheck] Report [Diagnostic Study] (Pages 1-2)"))) == "Report"
    assert one(spark, X.seconds(F.lit("1.5s"))) == 1.5
    assert one(spark, P.job_timeout(F.lit(10), 120, 1.0, 500)) == 1
    assert one(spark, X.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0
