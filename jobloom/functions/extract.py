"""Facts read out of free text: experience, salary, place, eligibility, labelled fields."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions.text import _col, capture, clean, join_nonempty, let, nonempty, strip

MAX_SALARY = 9_999_999_999
PAY_WORDS = "salary|remuneration|compensation|pay|stipend|rwf|usd|eur|frw"


def _has(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def experience_years(text: Column | str) -> Column:
    """``0``, ``a-b``, ``n+``, ``n`` or ``''``; the first rule that applies decides."""
    return let(F.lower(F.coalesce(_col(text), F.lit(""))), _experience_years)


def _experience_years(t: Column) -> Column:
    unit = r"\s*(?:years?|yrs?)"
    span = r"(?U)(\d+)\s*(?:to|-)\s*(\d+)" + unit
    open_end = r"(?U)(\d+)\s*\+" + unit
    minimum = r"(?U)(?:at\s+least|minimum|over|more\s+than)\s+(\d+)" + unit
    plain = r"(?U)(\d+)" + unit

    def g(p: str, i: int = 1) -> Column:
        return F.regexp_extract(t, p, i)

    return (
        F.when(t.rlike(r"(?U)no\s+(?:prior\s+)?experience"), "0")
        .when(t.rlike(span), F.concat(g(span), F.lit("-"), g(span, 2)))
        .when(t.rlike(open_end), F.concat(g(open_end), F.lit("+")))
        .when(t.rlike(minimum), F.concat(g(minimum), F.lit("+")))
        .otherwise(g(plain))
    )


def salary(text: Column | str, strict: bool = True) -> Column:
    """struct(salary_min, salary_max, currency, salary_disclosed).

    Strict: numbers count only when a pay word occurs, a range or one number of at
    least four characters.  Loose: a range of digits anywhere, nothing else.
    """
    return let(F.coalesce(_col(text), F.lit("")), lambda t: _salary(t, strict))


def _salary(text: Column, strict: bool) -> Column:
    pieces = F.struct(F.lower(text).alias("low"), F.replace(text, F.lit(","), F.lit("")).alias("digits"))
    return let(pieces, lambda x: _numbers(x["low"], x["digits"], strict))


def _numbers(low: Column, digits: Column, strict: bool) -> Column:
    currency = F.lit("")
    for code, symbols in reversed(list(vocab.CURRENCY.items())):
        currency = F.when(_has(low, symbols), code).otherwise(currency)
    number = r"([\d.]+)" if strict else r"(\d+)"
    span = rf"{number}(?U)\s*[-to]+\s*(?-U){number}"
    first = F.regexp_extract(digits, span, 1)
    # without a pay word the numbers do not count, and are not looked for
    gate = _has(low, PAY_WORDS.split("|"))
    found = F.struct(
        gate.alias("gate"),
        (F.when(gate, first) if strict else first).alias("first"),
        digits.alias("digits"),
        currency.alias("currency"),
    )

    def amounts(x: Column) -> Column:
        is_span = x["first"] != ""
        return F.struct(
            is_span.alias("is_span"),
            F.when(is_span, x["first"].try_cast("double")).alias("lo"),
            F.when(is_span, F.regexp_extract(x["digits"], span, 2).try_cast("double")).alias("hi"),
            F.when(~is_span, F.regexp_extract(x["digits"], r"([\d.]{4,})", 1).try_cast("double")).alias("one"),
            x["gate"].alias("gate"),
            x["currency"].alias("currency"),
        )

    return let(found, lambda x: let(amounts(x), lambda y: _amounts(y, strict)))


def _amounts(x: Column, strict: bool) -> Column:
    lo, hi, one = x["lo"], x["hi"], x["one"]
    gate, is_span, currency = x["gate"], x["is_span"], x["currency"]
    in_range = (lo <= MAX_SALARY) & (hi <= MAX_SALARY)
    if strict:
        low_end = F.when(gate & is_span & in_range, lo).when(gate & ~is_span & (one <= MAX_SALARY), one)
        high_end = F.when(gate & is_span & in_range, hi)
    else:
        low_end, high_end = F.when(in_range, lo), F.when(in_range, hi)
    return F.struct(
        low_end.try_cast("decimal(12,2)").alias("salary_min"),
        high_end.try_cast("decimal(12,2)").alias("salary_max"),
        currency.alias("currency"),
        low_end.isNotNull().alias("salary_disclosed"),
    )


def around_first(text: Column | str, words: str, before: int, after: int) -> Column:
    """The text around the first of ``words`` (a regex), null if none occurs."""
    t = _col(text)
    p = F.lit(f"(?i){words}")
    at = F.regexp_instr(t, p)
    start = F.greatest(at - before, F.lit(1))
    size = at + F.length(F.regexp_substr(t, p)) + after - start
    return F.when(at > 0, F.substring(t, start, size))


def place(
    text: Column | str,
    districts: Sequence[str] = vocab.DISTRICTS,
    remote_words: Sequence[str] = ("remote",),
) -> Column:
    """struct(location_raw, district, country, is_remote, is_hybrid)."""
    return let(F.coalesce(_col(text), F.lit("")), lambda t: _place(t, districts, remote_words))


def _place(text: Column, districts: Sequence[str], remote_words: Sequence[str]) -> Column:
    raw = F.coalesce(clean(text), F.lit(""))
    t = F.lower(text)
    # every district list starts with the capital, so naming it decides on its own
    first = F.filter(F.split(F.lit(" ".join(districts)), " "), lambda d: F.contains(t, d))
    return F.struct(
        raw.alias("location_raw"),
        F.coalesce(F.initcap(F.get(first, F.lit(0))), F.lit("")).alias("district"),
        F.lit("Rwanda").alias("country"),
        _has(t, remote_words).alias("is_remote"),
        F.contains(t, F.lit("hybrid")).alias("is_hybrid"),
    )


def named_district(text: Column | str) -> Column:
    """struct(district, country); text that names no known place is kept as the district."""
    return let(strip(F.coalesce(_col(text), F.lit(""))), _named_district)


def _named_district(raw: Column) -> Column:
    low = F.lower(raw)
    towns = F.split(F.lit(" ".join(vocab.DISTRICTS_TOWNS)), " ")
    found = F.get(F.filter(towns, lambda d: F.contains(low, F.lower(d))), F.lit(0))
    return F.struct(
        F.coalesce(found, F.when(low == "rwanda", "").otherwise(raw)).alias("district"),
        F.lit("Rwanda").alias("country"),
    )


def preferred_place(text: Column | str) -> Column:
    """Of ``a | b | c`` the first part that is local or remote, else the first part."""
    parts = F.transform(F.split(_col(text), r"\|"), strip)
    local = F.filter(parts, lambda p: F.lower(p).rlike("kigali|rwanda|remote"))
    return F.coalesce(F.get(local, F.lit(0)), F.get(parts, F.lit(0)))


def eligibility(
    title: Column | str,
    description: Column | str,
    location: Column | str,
    is_remote: Column | str,
    disqualifiers: Sequence[str] = vocab.DISQUALIFIERS_FULL,
    listed_on: str = "Listed",
    remote_reason: str = "Remote job - open globally",
    clause_reason: str = "Disqualifying clause: '%s'",
    country_reason: str = "Explicitly mentions Rwanda location",
    default_score: int = 3,
) -> Column:
    """struct(rwanda_eligible, eligibility_reason, confidence_score)."""
    def verdict(ok: bool, reason: str, score: int) -> Column:
        return F.struct(
            F.lit(ok).alias("rwanda_eligible"),
            F.lit(reason).alias("eligibility_reason"),
            F.lit(score).alias("confidence_score"),
        )

    def decide(text: Column) -> Column:
        out = F.when(F.coalesce(_col(is_remote), F.lit(False)), verdict(True, remote_reason, 4))
        for clause in disqualifiers:
            out = out.when(F.contains(text, F.lit(clause)), verdict(False, clause_reason % clause, 5))
        out = out.when(_has(text, vocab.COUNTRY_SIGNALS), verdict(True, country_reason, 5))
        return out.otherwise(verdict(True, listed_on, default_score))

    return let(F.lower(join_nonempty(title, description, location)), decide)


# --- fixed values: deadline phrases in running text --------------------------
_MON = "(?:" + "|".join(vocab.MONTH_ABBR) + ")[a-z]*"
DEADLINE_PHRASES = [
    rf"deadline[:\s]+(\d{{1,2}}\s+{_MON}\s+\d{{4}})",
    rf"(?:application|submission)\s+deadline[:\s]+({_MON}\s+\d{{1,2}},?\s+\d{{4}})",
    r"(?:closing|due)\s+date[:\s]+(\d{1,2}[-/]\d{1,2}[-/]\d{4})",
    rf"applications?\s+close\s+(?:on|by)[:\s]+(\d{{1,2}}\s+{_MON}\s+\d{{4}})",
    rf"apply\s+(?:before|by)[:\s]+(\d{{1,2}}\s+{_MON}\s+\d{{4}})",
    rf"deadline\s+is[:\s]+(\d{{1,2}}(?:st|nd|rd|th)?\s+{_MON}\s+\d{{4}})",
    r"deadline[:\s]+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
]
DEADLINE_PHRASES_NUMERIC = [
    r"deadline[:\s]+(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    r"not later than[^,\n]*?(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    r"closing date[:\s]+(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
]


def stated_deadline(text: Column | str) -> Column:
    """Deadline phrase of running text, ``Ongoing`` for open calls, else ``''``."""
    t = F.coalesce(_col(text), F.lit(""))
    found = F.coalesce(*[capture(t, p) for p in DEADLINE_PHRASES])
    plain = F.regexp_replace(found, r"(\d+)(?:st|nd|rd|th)", "$1")
    open_call = t.rlike(r"(?i)deadline[:\s]*(?:ongoing|continuous|rolling|open)")
    return F.coalesce(plain, F.when(open_call, "Ongoing"), F.lit(""))


def numeric_deadline(text: Column | str) -> Column:
    return F.coalesce(*[capture(text, p) for p in DEADLINE_PHRASES_NUMERIC])


FIELD_LABELS = (
    "Location", "Type", "Education", "Experience", "Positions", "Deadline", "Posted", "Published",
    "Category", "Job Category", "Duty Station", "Sector", "Contract type", "Quick Job Overview",
    "Job Description", "Deadline of this Job",
)


def labelled(text: Column | str, label: str, stops: Sequence[str] = FIELD_LABELS) -> Column:
    """Value after ``Label:`` up to the next label, line end, ``|`` or ``**``; null if absent."""
    others = "|".join(re.escape(s) for s in sorted(stops, key=len, reverse=True) if s != label)
    next_label = rf"|\s+(?:{others})\b" if others else ""
    return capture(text, rf"\b{label}\s*:\s*(.+?)(?:\s*\*\*|\s*\||\n{next_label}|$)")


def stated_place(text: Column | str, head: int | None = 500) -> Column:
    """Labelled place, else the first district named in the opening of the text."""
    t = F.coalesce(_col(text), F.lit(""))
    label = capture(
        t, r"(?:Location|Place\s+of\s+work|Work\s+station|Based\s+in)[:\s]+([^\n.]{3,60})"
    )
    districts = F.split(F.lit(" ".join(vocab.DISTRICTS)), " ")
    named = let(
        F.lower(F.substring(t, 1, head) if head else t),
        lambda opening: F.get(F.filter(districts, lambda d: F.contains(opening, d)), F.lit(0)),
    )
    return F.coalesce(label, F.initcap(named), F.lit(""))


def between_markers(text: Column | str, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the following ``end``; null unless both occur."""
    t = _col(text)
    a = F.instr(t, start)
    rest = F.substring(t, a + len(start), F.length(t))
    b = F.instr(rest, end)
    return F.when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b - 1))


def duties(text: Column | str, size: int | None = 500) -> Column:
    """The responsibilities section without its sub-heading."""
    section = strip(
        F.replace(
            between_markers(text, "Job responsibilities", "Qualifications"),
            F.lit("Duties and Responsibilities:"),
            F.lit(""),
        )
    )
    return F.coalesce(F.substring(section, 1, size) if size else section, F.lit(""))


def qualification_lines(text: Column | str, lines: int = 15, size: int | None = 1486) -> Column:
    """struct(qualifications, education, experience) of the qualifications section.

    Numbered lines and lines naming a degree among the first ``lines``, joined by `` | ``.
    """
    t = _col(text)
    at = F.instr(t, "Qualifications")
    tail = F.substring(t, at + len("Qualifications"), F.length(t))
    section = F.when(at > 0, F.substring(tail, 1, size) if size else tail)
    low = F.lower(section)
    picked = F.filter(
        F.transform(F.slice(F.split(section, "\n"), 1, lines), strip),
        lambda x: x.rlike(r"(?U)^\d") | F.lower(x).rlike("degree|bachelor|master"),
    )
    years = nonempty(F.regexp_extract(low, r"(\d+)\s*years?\s*of\s*(?:relevant\s*)?experience", 1))
    return F.struct(
        F.coalesce(F.array_join(picked, " | "), F.lit("")).alias("qualifications"),
        F.when(low.rlike("phd|doctorate"), "PhD")
        .when(F.contains(low, F.lit("master")), "Master")
        .when(F.contains(low, F.lit("bachelor")), "Bachelor")
        .otherwise("")
        .alias("education"),
        F.coalesce(F.concat(years, F.lit(" years")), F.lit("")).alias("experience"),
    )
