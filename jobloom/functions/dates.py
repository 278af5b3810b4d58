"""Date parsing.  Every "now" is the explicit ``as_of`` argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions.text import _col, let, strip

_MONTHS = "|".join(vocab.MONTH_ABBR)
YEARS = (2020, 2030)


def _month_number(name: Column) -> Column:
    """Two-digit month of a name by its first three letters, null if unknown."""
    i = F.instr(F.lit("".join(vocab.MONTH_ABBR)), F.lower(F.substring(name, 1, 3)))
    known = (F.length(name) >= 3) & (i % 3 == 1)
    return F.when(known, F.lpad(((i + 2) / 3).cast("int").cast("string"), 2, "0"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A real calendar day, null otherwise."""
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_date(c: Column | str, years: tuple[int, int] = YEARS) -> Column:
    """Free text to date: day-first forms, month names, ISO; null when it is not a date.

    Forms are tried in order and match at the start of the text; a form that gives
    no real day inside the year window falls through to the next one.
    """
    s = strip(F.regexp_replace(strip(_col(c)), r"(?i)^(?:on|by|before|until|deadline:?)\s+", ""))
    # each form rewrites matching text to year-month-day
    forms = [
        (rf"(?is)^(\d{{1,2}})\s+({_MONTHS})[a-z]*\s+(\d{{4}}).*$", "$3-$2-$1", "yyyy-MMM-d"),
        (rf"(?is)^({_MONTHS})[a-z]*\s+(\d{{1,2}}),?\s+(\d{{4}}).*$", "$3-$1-$2", "yyyy-MMM-d"),
        (r"(?s)^(\d{1,2})[/-](\d{1,2})[/-](\d{4}).*$", "$3-$2-$1", "yyyy-M-d"),
        (r"(?s)^(\d{4})[/-](\d{1,2})[/-](\d{1,2}).*$", "$1-$2-$3", "yyyy-M-d"),
    ]

    def parsed(x: Column) -> Column:
        # the rlike guard keeps text of another form away from the costly failing parse
        days = F.array(
            *[F.when(x.rlike(p), F.try_to_date(F.regexp_replace(x, p, r), f)) for p, r, f in forms]
        )
        return F.when(
            ~F.lower(x).isin(vocab.NOT_A_DATE),
            F.get(F.filter(days, lambda d: F.year(d).between(*years)), F.lit(0)),
        )

    return let(s, parsed)


def valid_date(c: Column | str, years: tuple[int, int] = YEARS) -> Column:
    """True for ``yyyy-MM-dd`` text that is a real day inside the year window."""
    d = F.try_to_date(F.when(_col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _col(c)), "yyyy-M-d")
    return F.coalesce(F.year(d).between(*years), F.lit(False))


def loose_deadline(c: Column | str) -> Column:
    """``dd/mm/yyyy``, ``dd.mm.yyyy`` or any text with a month name to ISO; else the text.

    No calendar check: the loader parses the result again.
    """
    return let(strip(F.coalesce(_col(c), F.lit(""))), _loose_deadline)


def _loose_deadline(t: Column) -> Column:
    numeric = r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})"
    low = F.lower(t)
    # full names are tried before abbreviations, each in calendar order
    names = [(n, i + 1) for i, n in enumerate(vocab.MONTH_NAMES)]
    names += [(n, i + 1) for i, n in enumerate(vocab.MONTH_ABBR) if n != "may"]
    month = F.coalesce(*[F.when(F.contains(low, F.lit(n)), F.lit(f"{m:02d}")) for n, m in names])
    day, year = F.regexp_extract(t, r"(\d{1,2})", 1), F.regexp_extract(t, r"(\d{4})", 1)
    iso = lambda y, m, d: F.concat_ws("-", y, m, d)
    return (
        F.when(
            t.rlike(numeric),
            iso(
                F.regexp_extract(t, numeric, 3),
                F.lpad(F.regexp_extract(t, numeric, 2), 2, "0"),
                F.lpad(F.regexp_extract(t, numeric, 1), 2, "0"),
            ),
        )
        .when(
            month.isNotNull() & (day != "") & (year != ""),
            iso(year, month, F.lpad(day, 2, "0")),
        )
        .otherwise(t)
    )


def dashed_day_first(c: Column | str) -> Column:
    """``d-m-yyyy`` at the start to ISO; other text unchanged."""
    p = r"^(\d{1,2})-(\d{1,2})-(\d{4})"
    s = F.trim(_col(c))
    iso = F.concat_ws(
        "-",
        F.regexp_extract(s, p, 3),
        F.lpad(F.regexp_extract(s, p, 2), 2, "0"),
        F.lpad(F.regexp_extract(s, p, 1), 2, "0"),
    )
    return F.coalesce(F.when(s.rlike(p), iso).otherwise(_col(c)), F.lit(""))


def published_and_deadline(text: Column | str) -> Column:
    """``Published on d-m-yyyy`` and ``Deadline d-m-yyyy`` of a card -> struct of ISO dates."""
    t = _col(text)

    def pick(label: str) -> Column:
        return dashed_day_first(F.regexp_extract(t, rf"(?i){label}\s+(\d{{1,2}}-\d{{1,2}}-\d{{4}})", 1))

    return F.struct(pick(r"published\s+on").alias("posted_date"), pick("deadline").alias("deadline"))


def days_ago(c: Column | str, as_of: Column) -> Column:
    """``Today`` / ``N days ago`` to ISO; other text stripped."""
    t = strip(F.coalesce(_col(c), F.lit("")))
    low = F.lower(t)
    n = F.regexp_extract(low, r"(\d+)\s+day", 1)
    today = F.to_date(as_of)
    return (
        F.when(F.contains(low, F.lit("today")), F.date_format(today, "yyyy-MM-dd"))
        .when(n != "", F.date_format(F.date_sub(today, n.try_cast("int")), "yyyy-MM-dd"))
        .otherwise(t)
    )


def relative_day(c: Column | str, as_of: Column) -> Column:
    """Relative age (hours to years) as ``on dd-MM-yyyy``; ``''`` when not understood."""
    return let(strip(F.lower(F.coalesce(_col(c), F.lit("")))), lambda low: _relative_day(low, as_of))


def _relative_day(low: Column, as_of: Column) -> Column:
    n = F.regexp_extract(low, r"(\d+)", 1).try_cast("int")
    today = F.to_date(as_of)

    def says(word: str) -> Column:
        return F.contains(low, F.lit(word))

    month = F.add_months(F.trunc(today, "month"), -n)
    month_day = F.date_add(month, F.least(F.day(today), F.lit(28)) - 1)
    year_day = _day(
        F.lpad((F.year(today) - n).cast("string"), 4, "0"),
        F.month(today).cast("string"),
        F.day(today).cast("string"),
    )
    day = (
        F.when(says("hour") | says("minute"), today)
        .when(says("day"), F.date_sub(today, n))
        .when(says("week"), F.date_sub(today, n * 7))
        .when(says("month"), month_day)
        .when(says("year"), year_day)
    )
    return F.coalesce(F.concat(F.lit("on "), F.date_format(day, "dd-MM-yyyy")), F.lit(""))


def slashed_day(c: Column | str) -> Column:
    """``dd/mm/yyyy [hh:mm]`` as ``on dd-mm-yyyy``; other text stripped."""
    t = strip(F.coalesce(_col(c), F.lit("")))
    p = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\s|$)"
    day = _day(F.regexp_extract(t, p, 3), F.regexp_extract(t, p, 2), F.regexp_extract(t, p, 1))
    return F.coalesce(F.concat(F.lit("on "), F.date_format(day, "dd-MM-yyyy")), t)


def abbreviated_us(c: Column | str) -> Column:
    """``Mon d, yyyy`` to ISO; ``''`` when absent or the month is unknown."""
    p = r"([A-Z][a-z]{2}) (\d{1,2}), (\d{4})"
    t = _col(c)
    return F.coalesce(
        F.concat(
            F.regexp_extract(t, p, 3),
            F.lit("-"),
            _month_number(F.regexp_extract(t, p, 1)),
            F.lit("-"),
            F.lpad(F.regexp_extract(t, p, 2), 2, "0"),
        ),
        F.lit(""),
    )


def slashed_month_name(c: Column | str) -> Column:
    """``d/Mon/yyyy`` to ISO, an unknown month counts as January; other text stripped."""
    p = r"(\d{1,2})/(\w{3})/(\d{4})"
    t = strip(F.coalesce(_col(c), F.lit("")))
    iso = F.concat_ws(
        "-",
        F.regexp_extract(t, p, 3),
        F.coalesce(_month_number(F.regexp_extract(t, p, 2)), F.lit("01")),
        F.lpad(F.regexp_extract(t, p, 1), 2, "0"),
    )
    return F.when(t.rlike(p), iso).otherwise(t)


def feed_day(c: Column | str) -> Column:
    """RFC 822 time stamp as ``on dd-mm-yyyy`` in its own zone; ``''`` when malformed."""
    p = (
        r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun), (\d{1,2}) ("
        + _MONTHS
        + r") (\d{4}) \d{1,2}:\d{1,2}:\d{1,2} (?:[+-]\d{2}:?\d{2}|Z)$"
    )
    t = _col(c)
    day = _day(
        F.regexp_extract(t, p, 3), _month_number(F.regexp_extract(t, p, 2)), F.regexp_extract(t, p, 1)
    )
    return F.coalesce(F.concat(F.lit("on "), F.date_format(day, "dd-MM-yyyy")), F.lit(""))


def end_of_day(c: Column | str) -> Column:
    """Midnight time stamps move to 23:59:59 of the same day."""
    t = _col(c).cast("timestamp")
    midnight = (F.hour(t) == 0) & (F.minute(t) == 0) & (F.second(t) == 0)
    return F.when(midnight, t + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).otherwise(t)


def microseconds_left(deadline: Column | str, as_of: Column) -> Column:
    return F.unix_micros(_col(deadline)) - F.unix_micros(as_of)


def days_left(deadline: Column | str, as_of: Column) -> Column:
    """Whole days to the deadline, floored: one second late is -1."""
    return F.floor(microseconds_left(deadline, as_of) / F.lit(86_400_000_000)).cast("bigint")
