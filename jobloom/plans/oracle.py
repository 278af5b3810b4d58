"""Pieces of the check SQL that runs beside the registered queries.

The SQL is written for DuckDB and shares nothing with the library but the fixed
vocabularies, so it states each rule a second time.
"""

from __future__ import annotations

import re

from jobloom import vocab
from jobloom.plans.fixtures import AS_OF_SQL, JOB_POSTINGS_SQL

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"\pL\pM\pN_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(BLANK + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{BLANK}+|{BLANK}+$')}, '', 'g')"


def _bounded(word: str) -> str:
    tail = rf"(?:$|[^{WORD}])" if re.match(r"\w", word[-1]) else f"[{WORD}]"
    return rf"(?:^|[^{WORD}])" + re.escape(word).replace("\\ ", " ").replace("\\&", "&") + tail


def keyword(text: str, kmap: dict, title: str | None = None, mode: str = "substring") -> str:
    """Longest keyword decides, ties go to the earlier category; the title is asked first."""
    words = [(w, c, o) for o, (c, ws) in enumerate(kmap.items()) for w in ws]
    words.sort(key=lambda x: (-len(x[0]), x[2]))

    def chain(h: str) -> str:
        tests = []
        for w, c, _ in words:
            short = len(w) <= 4 or (mode == "boundary_stripped" and w.rstrip() in vocab.BOUNDARY_WORDS)
            if mode != "substring" and short:
                needle = w.strip() if mode == "boundary_stripped" else w
                tests.append(f"WHEN regexp_matches(lower({h}), {q(_bounded(needle))}) THEN {q(c)}")
            else:
                tests.append(f"WHEN contains(lower({h}), {q(w)}) THEN {q(c)}")
        return "CASE " + " ".join(tests) + " END"

    return chain(text) if title is None else f"coalesce({chain(title)}, {chain(text)})"


_MON = "|".join(vocab.MONTH_ABBR)


def month_number(x: str) -> str:
    return f"lpad(CAST((position(lower({x}) IN {q(''.join(vocab.MONTH_ABBR))}) + 2) // 3 AS VARCHAR), 2, '0')"


def parse_date(x: str, years: tuple[int, int] = (2020, 2030)) -> str:
    s = strip(f"regexp_replace({strip(x)}, '(?i)^(on|by|before|until|deadline:?)\\s+', '')")
    p1 = rf"(?i)^(\d{{1,2}})\s+({_MON})[a-z]*\s+(\d{{4}})"
    p2 = rf"(?i)^({_MON})[a-z]*\s+(\d{{1,2}}),?\s+(\d{{4}})"
    p3, p4 = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})"

    def g(p: str, i: int) -> str:
        return f"regexp_extract({s}, {q(p)}, {i})"

    def day(y: str, m: str, d: str) -> str:
        date = f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
        return f"CASE WHEN year({date}) BETWEEN {years[0]} AND {years[1]} THEN {date} END"

    forms = [
        day(g(p1, 3), month_number(g(p1, 2)), g(p1, 1)),
        day(g(p2, 3), month_number(g(p2, 1)), g(p2, 2)),
        day(g(p3, 3), g(p3, 2), g(p3, 1)),
        day(g(p4, 1), g(p4, 2), g(p4, 3)),
    ]
    words = ", ".join(q(w) for w in vocab.NOT_A_DATE)
    return f"CASE WHEN lower({s}) NOT IN ({words}) THEN coalesce({', '.join(forms)}) END"


def loose_deadline(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    num = r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})"
    names = [(n, i + 1) for i, n in enumerate(vocab.MONTH_NAMES)]
    names += [(n, i + 1) for i, n in enumerate(vocab.MONTH_ABBR) if n != "may"]
    month = "CASE " + " ".join(f"WHEN contains(lower({t}), {q(n)}) THEN '{m:02d}'" for n, m in names) + " END"
    day, year = f"regexp_extract({t}, '(\\d{{1,2}})', 1)", f"regexp_extract({t}, '(\\d{{4}})', 1)"
    return (
        f"CASE WHEN regexp_matches({t}, {q(num)}) THEN regexp_extract({t}, {q(num)}, 3) || '-' || "
        f"lpad(regexp_extract({t}, {q(num)}, 2), 2, '0') || '-' || lpad(regexp_extract({t}, {q(num)}, 1), 2, '0') "
        f"WHEN {month} IS NOT NULL AND {day} <> '' AND {year} <> '' THEN {year} || '-' || {month} || '-' || lpad({day}, 2, '0') "
        f"ELSE {t} END"
    )


def experience(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    unit = r"\s*(?:years?|yrs?)"
    span, plus = r"(\d+)\s*(?:to|-)\s*(\d+)" + unit, r"(\d+)\s*\+" + unit
    least, plain = r"(?:at\s+least|minimum|over|more\s+than)\s+(\d+)" + unit, r"(\d+)" + unit
    return (
        f"CASE WHEN regexp_matches({t}, 'no\\s+(?:prior\\s+)?experience') THEN '0' "
        f"WHEN regexp_matches({t}, {q(span)}) THEN regexp_extract({t}, {q(span)}, 1) || '-' || regexp_extract({t}, {q(span)}, 2) "
        f"WHEN regexp_matches({t}, {q(plus)}) THEN regexp_extract({t}, {q(plus)}, 1) || '+' "
        f"WHEN regexp_matches({t}, {q(least)}) THEN regexp_extract({t}, {q(least)}, 1) || '+' "
        f"ELSE regexp_extract({t}, {q(plain)}, 1) END"
    )


PAY = r"(?i)salary|remuneration|compensation|pay|stipend|rwf|usd|eur|frw"
_SPAN, _ONE = r"([\d.]+)\s*[-to]+\s*([\d.]+)", r"([\d.]{4,})"


def _number(x: str) -> str:
    n = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {n} <= 9999999999 THEN {n} END"


def salary_min(x: str) -> str:
    d = f"replace({x}, ',', '')"
    lo, hi = _number(f"regexp_extract({d}, {q(_SPAN)}, 1)"), _number(f"regexp_extract({d}, {q(_SPAN)}, 2)")
    one = _number(f"regexp_extract({d}, {q(_ONE)}, 1)")
    return (
        f"CAST(CASE WHEN NOT regexp_matches({x}, {q(PAY)}) THEN NULL WHEN regexp_matches({d}, {q(_SPAN)}) "
        f"THEN CASE WHEN ({hi}) IS NOT NULL THEN {lo} END ELSE {one} END AS DECIMAL(12,2))"
    )


def salary_max(x: str) -> str:
    d = f"replace({x}, ',', '')"
    lo, hi = _number(f"regexp_extract({d}, {q(_SPAN)}, 1)"), _number(f"regexp_extract({d}, {q(_SPAN)}, 2)")
    return (
        f"CAST(CASE WHEN regexp_matches({x}, {q(PAY)}) AND ({lo}) IS NOT NULL THEN {hi} END AS DECIMAL(12,2))"
    )


def currency(x: str) -> str:
    tests = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {q(w)})" for w in ws) + f" THEN {q(c)}"
        for c, ws in vocab.CURRENCY.items()
    )
    return f"CASE {tests} ELSE '' END"


def district(x: str) -> str:
    tests = " ".join(f"WHEN contains(lower({x}), {q(d)}) THEN {q(d.capitalize())}" for d in vocab.DISTRICTS)
    return f"CASE {tests} ELSE '' END"


def eligibility(part: str) -> str:
    text = "lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(location_raw, '')))"
    pick = {"rwanda_eligible": 0, "eligibility_reason": 1, "confidence_score": 2}[part]
    rules = [("contains(lower(location_raw), 'remote')", ("true", "'Remote job - open globally'", "4"))]
    rules += [
        (f"contains({text}, {q(d)})", ("false", q(f"Disqualifying clause: '{d}'"), "5"))
        for d in vocab.DISQUALIFIERS_FULL
    ]
    rules.append((f"contains({text}, 'rwanda') OR contains({text}, 'kigali')", ("true", "'Explicitly mentions Rwanda location'", "5")))
    last = ("true", "'Listed on jobinrwanda.com'", "3")[pick]
    return "CASE " + " ".join(f"WHEN {c} THEN {v[pick]}" for c, v in rules) + f" ELSE {last} END"


def title_key(x: str) -> str:
    return f"coalesce({squeeze(f'lower({x})')}, '')"


def company_key(x: str) -> str:
    acronym = f"upper(regexp_extract({x}, '(?i)\\(([a-z]{{2,10}})\\)', 1))"
    cut = f"regexp_replace({x}, '(?i)\\b(?:ltd|plc|inc|llc|limited|rwanda|formerly.*)\\b.*$', '')"
    cut = f"regexp_replace({strip(cut)}, '[.,\\- ]+$', '')"
    return f"coalesce(nullif({acronym}, ''), {squeeze(f'lower({cut})')}, '')"


def company_base(x: str) -> str:
    b = strip(f"lower(split_part({x}, '(', 1))")
    return f"CASE WHEN length({b}) >= 4 THEN {b} END"


# --- the derived job table --------------------------------------------------
JP = f"jp AS ({JOB_POSTINGS_SQL})"
JOBS = f"""{JP}, jobs AS (
  SELECT id, title, company, source, source_url, scraped_at, is_active, description, location_raw,
    coalesce({keyword("concat_ws(' ', title, description)", vocab.SECTOR, "title")}, '') AS sector,
    {district("location_raw")} AS district,
    coalesce({keyword("concat_ws(' ', title, description)", vocab.EMPLOYMENT, "title")}, '') AS employment_type,
    coalesce({keyword("' ' || description", vocab.LEVEL, "title")}, '') AS job_level,
    {experience("description")} AS experience_years,
    coalesce({keyword("description", vocab.EDUCATION)}, '') AS education_level,
    {parse_date("deadline_raw")} AS deadline
  FROM jp)"""
ACTIVE = f"""{JOBS}, act AS (
  SELECT *, CAST(deadline AS TIMESTAMP) + INTERVAL '23:59:59' AS due,
    CAST(floor((epoch_us(CAST(deadline AS TIMESTAMP) + INTERVAL '23:59:59') - epoch_us({AS_OF_SQL})) / 86400000000.0) AS BIGINT) AS days_to_deadline
  FROM jobs WHERE is_active), live AS (SELECT * FROM act WHERE days_to_deadline >= 0)"""
