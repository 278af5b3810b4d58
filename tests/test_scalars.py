"""One table of (function, input, result) per scalar group, run as one Spark job each."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions import classify as C
from jobloom.functions import dates as D
from jobloom.functions import extract as X
from jobloom.functions import text as T
from jobloom.functions.similarity import COMPANY, TITLE
from jobloom.operators import positions as P


def as_of():
    return F.lit("2026-03-18 10:00:00").cast("timestamp")


def evaluate(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "experience": (
        X.experience_years,
        {
            "at least 3 years": "3+", "minimum 2 years": "2+", "3 to 5 years": "3-5",
            "3 - 5 years experience": "3-5", "2+ years": "2+", "no experience required": "0",
            "No prior experience": "0", "7 yrs": "7", "": "", "at least 3 years": "3+", None: "",
        },
    ),
    "parse_date": (
        D.parse_date,
        {
            "30 March 2026": dt.date(2026, 3, 30), "19/03/2026": dt.date(2026, 3, 19),
            "05/03/2026": dt.date(2026, 3, 5), "March 30, 2026": dt.date(2026, 3, 30),
            "Mar 16 2026": dt.date(2026, 3, 16), "2026-03-30": dt.date(2026, 3, 30),
            "2026-02-19T17:24:02+02:00": dt.date(2026, 2, 19), "on 27-03-2026": dt.date(2026, 3, 27),
            "Deadline: 1 Sept 2026": dt.date(2026, 9, 1), "Ongoing": None, "ASAP": None, "1/26/2026": None,
            "15th March 2026": None, "19.03.2026": None, "31/02/2026": None, "01/01/2031": None,
            "2026/3/4": dt.date(2026, 3, 4), "": None, None: None, "27-03-2026 17:00": dt.date(2026, 3, 27),
        },
    ),
    "loose_deadline": (
        D.loose_deadline,
        {
            "08th March 2026": "2026-03-08", "10/03/2026": "2026-03-10", "19.03.2026 at 2:30 PM": "2026-03-19",
            "Thursday, March 12, 2026": "2026-03-12", "March 3, 2026, at 5:00 PM": "2026-03-03",
            "soon": "soon", "": "", None: "",
        },
    ),
    "relative": (
        lambda c: D.relative_day(c, as_of()),
        {
            "Posted 2 months ago": "on 18-01-2026", "Posted 3 days ago": "on 15-03-2026",
            "5 hours ago": "on 18-03-2026", "2 weeks ago": "on 04-03-2026", "1 year ago": "on 18-03-2025",
            "months ago": "", "": "", None: "", "yesterday": "",
        },
    ),
    "days_ago": (
        lambda c: D.days_ago(c, as_of()),
        {"Today": "2026-03-18", "1 Day Ago": "2026-03-17", "3 Days Ago": "2026-03-15", " x ": "x", None: ""},
    ),
    "feed_day": (
        D.feed_day,
        {"Wed, 18 Mar 2026 23:30:00 -0500": "on 18-03-2026", "Wed, 18 Mar 2026": "", None: ""},
    ),
    "slashed": (D.slashed_day, {"19/04/2026 17:00": "on 19-04-2026", "soon": "soon", "32/01/2026": "32/01/2026"}),
    "named_month": (D.slashed_month_name, {"5/Mar/2026": "2026-03-05", "5/Xyz/2026": "2026-01-05", "x": "x"}),
    "us": (D.abbreviated_us, {"Mar 14, 2026": "2026-03-14", "Xyz 14, 2026": "", "none": ""}),
    "announcement": (
        lambda c: F.concat_ws("|", *[T.announcement_title(c)[f] for f in ("title", "company", "deadline", "positions_count")]),
        {
            "Accountant at RDB: (Deadline 28 Feb 2026)": "Accountant|RDB|28 Feb 2026|",
            "10 Job Positions at NISR: (Deadline Ongoing)": "10 Positions at NISR|NISR|Ongoing|10",
            "5 Positions of Nurse at CHUK: (Deadline 1 March 2026)": "Nurse|CHUK|1 March 2026|5",
            "Just a headline": "Just a headline|||",
        },
    ),
    "stated_deadline": (
        X.stated_deadline,
        {
            "Deadline: 15 March 2026": "15 March 2026", "Application deadline: March 15, 2026": "March 15, 2026",
            "Closing date: 15/03/2026": "15/03/2026", "Applications close on 15 March 2026": "15 March 2026",
            "Apply before 15 March 2026": "15 March 2026", "Deadline is 15th March 2026": "15 March 2026",
            "deadline: rolling": "Ongoing", "none": "",
        },
    ),
    "organisation": (
        lambda c: F.concat_ws("|", T.organisation_and_deadline(c)["company"], T.organisation_and_deadline(c)["deadline"]),
        {
            "UNICEF": "UNICEF|", "WFP | Deadline: 7 January 2026": "WFP|7 January 2026",
            "World Bank Group | Closing Date: 1/26/2026": "World Bank Group|1/26/2026",
            "UNDP | Application close: Mar 16 2026": "UNDP|Mar 16 2026",
        },
    ),
    "phrase_grade": (
        C.phrase_grade_level,
        {
            "IPSA-9 - Junior level": "Entry", "NPSA-10 - Mid level": "Mid", "Managerial Level - Senior level": "Senior",
            "NPSA-4 - Administrative support": "Entry", "Level not specified": "", None: "",
        },
    ),
    "phrase_employment": (
        C.phrase_grade_employment,
        {"CON": "Consultancy", "International level": "Contract", "Intern": "Internship", "UNV": "Volunteer", None: "Contract"},
    ),
    "company_key": (
        T.company_key,
        {
            "Catholic Relief Services (CRS)": "CRS", "GIZ Rwanda": "giz", "X (Rwanda)": "RWANDA", "Rwanda Energy": "",
            "Acme, Ltd.": "acme", "Alight (formerly ARC International)": "alight (", "": "", None: "",
        },
    ),
    "deadline_key": (
        T.deadline_key,
        {"on 27-03-2026": "27-03-2026", "27/03/2026": "27-03-2026", "27-03-2026 17:00": "27-03-2026", "": "", None: ""},
    ),
    "clean": (T.clean, {"a  \n b ": "a b", " \t": None, "": None}),
    "substring_mode": (
        lambda c: C.keyword_category(c, vocab.EMPLOYMENT),
        {"International affairs": "Internship", "contractor": "Contract", "nothing": None, "": None},
    ),
    "raw_boundary": (
        lambda c: C.keyword_category(c, vocab.LEVEL, mode=C.BOUNDARY_RAW),
        {"contractor": None, "the CTO": "Executive", "vp sales": "Executive", "vp": None, "mid-size": "Mid", "midst": None},
    ),
    "stripped_boundary": (
        lambda c: C.keyword_category(c, vocab.LEVEL, mode=C.BOUNDARY_STRIPPED),
        {"international": None, "an intern": "Internship", "vp": "Executive", "Élève vp": "Executive"},
    ),
    "first_match": (
        lambda c: C.first_match_sector(F.lit(""), c),
        {"Nursing lead": "Healthcare", "Security guard": "IT", "Teacher": "Education", "Zzz": "Other"},
    ),
    "preferred_place": (X.preferred_place, {"Nairobi | Kigali": "Kigali", "Paris | Rome": "Paris", "Huye": "Huye"}),
    "stated_place": (X.stated_place, {"Work station: Huye district. More": "Huye district", "we are in musanze": "Musanze", "": ""}),
    "multi": (P.is_multi_position, {"10 Job Positions": True, "1 position": False, "Several roles": True, "Nurse": False}),
    "valid_title": (
        P.valid_title,
        {"Nurse": True, "HR": False, "How to apply as nurse": False, "Gardener": False},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    fn, table = CASES[name]
    assert evaluate(spark, fn, list(table)) == list(table.values())


def test_salary(spark):
    rows = {
        "Salary RWF 500,000 - 800,000.": (500000, 800000, "RWF", True),
        "Pay: USD 1500": (1500, None, "USD", True),
        "Call 0788123456": (None, None, "", False),
        "pay 1.2.3 - 5": (None, None, "", False),
        "salary 12,345,678,901": (None, None, "", False),
        "": (None, None, "", False),
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = df.select("i", X.salary("x").alias("s")).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == list(rows.values())
    loose = spark.createDataFrame([("from 10 to 20 people",)], "x string").select(X.salary("x", False).alias("s")).head()
    assert tuple(loose.s) == (10, 20, "", True)


def test_deadline_clock(spark):
    df = spark.sql(
        "SELECT TIMESTAMP '2026-03-18 00:00:00' AS midnight, TIMESTAMP '2026-03-18 09:59:59' AS late, CAST(NULL AS TIMESTAMP) AS none"
    )
    r = df.select(
        D.end_of_day("midnight").alias("end"), D.days_left(D.end_of_day("midnight"), as_of()).alias("a"),
        D.days_left("late", as_of()).alias("b"), D.days_left("none", as_of()).alias("c"),
    ).head()
    assert (r.end, r.a, r.b, r.c) == (dt.datetime(2026, 3, 18, 23, 59, 59), 0, -1, None)


def test_bare_title(spark):
    rows = [
        ("Data Analyst, NO-2, UNICEF, Kigali, Rwanda, #00107210", "UNICEF", "NO-2", "Data Analyst"),
        ("Driver, Fixed-Term, Kigali", "WFP", "", "Driver"),
        ("Cook, A.B (C), rwanda", "a.b (c)", "", "Cook"),
    ]
    df = spark.createDataFrame(rows, "raw string, company string, grade string, want string")
    assert all(r.got == r.want for r in df.select("want", T.bare_title("raw", "company", "grade").alias("got")).collect())


def test_gram_bound_is_sound():
    """Random similar strings share at least the promised number of distinct q-grams."""
    rnd = random.Random(3)
    for t in (TITLE, COMPANY):
        for _ in range(3000):
            a = "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(4, 40)))
            b = list(a)
            for _ in range(rnd.randrange(1, 5)):
                at = rnd.randrange(len(b) + 1)
                b[at:at + rnd.randrange(2)] = rnd.choice(["", "x", "a"])
            b = "".join(b)
            if not b or difflib.SequenceMatcher(None, a, b).ratio() <= 1 - t.num / t.den:
                continue
            grams = [[s[i:i + t.q] for i in range(len(s) - t.q + 1)] for s in (a, b)]
            for g, s in zip(grams, (a, b)):
                repeats = len(g) - len(set(g))
                assert len(set(grams[0]) & set(grams[1])) >= t.fewest_shared(len(s)) - repeats
