"""Text clean-up, keys, URL pieces and title/company splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that count as blanks in the data model
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Without the lambda binding Spark would repeat the value's expression at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonempty(c: Column | str) -> Column:
    """Null when the value is null or ``''``."""
    return F.nullif(_col(c), F.lit(""))


def first_nonempty(*cols: Column | str, default: str | None = None) -> Column:
    """First value that is neither null nor ``''``."""
    picks = [nonempty(c) for c in cols]
    if default is not None:
        picks.append(F.lit(default))
    return F.coalesce(*picks)


def squeeze(c: Column | str) -> Column:
    """Collapse runs of blanks to one space and cut both ends."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def clean(c: Column | str) -> Column:
    """Like :func:`squeeze`, null when nothing is left."""
    return nonempty(squeeze(c))


def strip(c: Column | str) -> Column:
    """Cut blanks of any kind from both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def capture(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Case-insensitive capture, stripped; null when nothing (or only blanks) is caught."""
    return nonempty(strip(F.regexp_extract(_col(c), "(?i)" + pattern, group)))


def join_nonempty(*cols: Column | str) -> Column:
    """The non-empty values separated by one space."""
    return F.concat_ws(" ", *[nonempty(c) for c in cols])


def identity(*cols: Column | str) -> Column:
    """md5 hex of the concatenated values."""
    parts = [_col(c) for c in cols]
    return F.md5(F.encode(parts[0] if len(parts) == 1 else F.concat(*parts), "utf-8"))


# --- duplicate keys ---------------------------------------------------------


def title_key(c: Column | str) -> Column:
    """Lower case, blanks collapsed; ``''`` for null."""
    return F.coalesce(squeeze(F.lower(_col(c))), F.lit(""))


def company_key(c: Column | str, fold_acronym: bool = False) -> Column:
    """An acronym in parentheses wins; otherwise the name up to the first legal-form word."""
    c = _col(c)
    acronym = F.upper(F.regexp_extract(c, r"(?i)\(([a-z]{2,10})\)", 1))
    base = F.regexp_replace(
        c, r"(?is)\b(?:ltd|plc|inc|llc|limited|rwanda|formerly[^\n]*)\b[^\n]*$", ""
    )
    base = squeeze(F.lower(F.regexp_replace(strip(base), r"[.,\- ]+$", "")))
    if fold_acronym:
        acronym = F.lower(acronym)
    return F.coalesce(nonempty(acronym), base, F.lit(""))


def company_base(c: Column | str) -> Column:
    """Lower-cased name before the first parenthesis; null under four characters."""
    b = strip(F.lower(F.substring_index(_col(c), "(", 1)))
    return F.when(F.length(b) >= 4, b)


def deadline_key(c: Column | str) -> Column:
    """Free-text deadline as a comparison key: first token, ``-`` as the only separator."""
    d = strip(F.regexp_replace(strip(F.lower(_col(c))), r"^on ", ""))
    d = F.regexp_extract(F.regexp_replace(d, r"[/.]", "-"), r"(?U)^(\S+)", 1)
    return F.coalesce(d, F.lit(""))


def date_key(c: Column | str) -> Column:
    """Deadline of date type as a comparison key."""
    return F.coalesce(F.date_format(_col(c), "yyyy-MM-dd"), F.lit(""))


# --- URLs -------------------------------------------------------------------


def url_path(url: Column | str) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def slug(url: Column | str) -> Column:
    """Last part of the path, trailing slashes ignored."""
    return F.substring_index(F.regexp_replace(url_path(url), r"/+$", ""), "/", -1)


def last_segment(url: Column | str) -> Column:
    """Last part of the raw link, query included."""
    return F.substring_index(F.regexp_replace(_col(url), r"/+$", ""), "/", -1)


def trailing_id(url: Column | str) -> Column:
    """Digits after the last ``-`` of the path, ``''`` if there are none."""
    return F.regexp_extract(F.regexp_replace(url_path(url), r"/+$", ""), r"-(\d+)$", 1)


def leading_id(url: Column | str) -> Column:
    """Digits the slug starts with, else its first 80 characters."""
    s = F.substring_index(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "/", -1)
    return F.coalesce(nonempty(F.regexp_extract(s, r"^(\d+)", 1)), F.substring(s, 1, 80))


def query_value(url: Column | str, key: str) -> Column:
    return nonempty(F.regexp_extract(_col(url), key + r"=([^&]+)", 1))


def host_of(url: Column | str) -> Column:
    """Scheme and host of an absolute URL."""
    return F.regexp_extract(_col(url), r"^(https?://[^/?#]+)", 1)


def resolve(base_url: Column | str, href: Column | str) -> Column:
    """Absolute link: absolute stays, rooted or relative is put under the host.

    ``base_url`` is a fixed address or a column with the page's own host.
    """
    href = _col(href)
    host = F.lit(base_url.rstrip("/")) if isinstance(base_url, str) else base_url
    return (
        F.when(href.rlike(r"^https?://"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(host, "//", 1), href))
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(host, F.lit("/"), href))
    )


def company_from_slug(c: Column | str, before: str | None = None) -> Column:
    """Readable company name from a link part; ``before`` cuts a fixed middle piece."""
    part = last_segment(c)
    if before:
        part = F.substring_index(part, before, 1)
    return F.initcap(F.replace(part, F.lit("-"), F.lit(" ")))


# --- titles -----------------------------------------------------------------


def role_at_company(c: Column | str) -> Column:
    """``Role at Company`` -> struct(title, company); no match leaves the title whole."""
    return let(_col(c), _role_at_company)


def _role_at_company(c: Column) -> Column:
    p = r"(?i)^(.+?)\s+at\s+(.+)$"
    hit = c.rlike(p)
    return F.struct(
        F.coalesce(F.when(hit, clean(F.regexp_extract(c, p, 1))), clean(c), F.lit("")).alias("title"),
        F.coalesce(F.when(hit, clean(F.regexp_extract(c, p, 2))), F.lit("")).alias("company"),
    )


def announcement_title(c: Column | str) -> Column:
    """Split an announcement headline into title, company, deadline and position count."""
    raw = F.coalesce(_col(c), F.lit(""))
    core = strip(F.regexp_replace(raw, r"(?i)\s*:?\s*\(Deadline.+?\)", ""))
    core = strip(F.regexp_replace(core, r":+$", ""))
    return let(
        F.struct(raw.alias("raw"), core.alias("core")), lambda x: _announcement(x["raw"], x["core"])
    )


def _announcement(raw: Column, core: Column) -> Column:
    many = r"(?i)^(\d+)\s+(?:job\s+)?positions?\s+(?:of\s+(.+?)\s+)?at\s+(.+)$"
    one = r"(?i)^(.+?)\s+at\s+(.+)$"
    is_many, is_one = core.rlike(many), core.rlike(one)
    count = F.regexp_extract(core, many, 1)
    many_company = F.coalesce(clean(F.regexp_extract(core, many, 3)), F.lit(""))
    title = (
        F.when(
            is_many,
            F.coalesce(
                clean(F.regexp_extract(core, many, 2)),
                F.concat(count, F.lit(" Positions at "), many_company),
            ),
        )
        .when(is_one, F.coalesce(clean(F.regexp_extract(core, one, 1)), raw))
        .otherwise(F.coalesce(clean(core), raw))
    )
    company = (
        F.when(is_many, many_company)
        .when(is_one, F.coalesce(clean(F.regexp_extract(core, one, 2)), F.lit("")))
        .otherwise("")
    )
    deadline = F.coalesce(capture(raw, r"\(Deadline[:\s]+(.+?)\)"), F.lit(""))
    return F.struct(
        title.alias("title"),
        company.alias("company"),
        deadline.alias("deadline"),
        F.when(is_many, count).otherwise("").alias("positions_count"),
    )


def _drop_suffix(title: Column, value: Column) -> Column:
    """Remove ``, value`` from the end, ignoring case."""
    return let(
        F.struct(title.alias("t"), value.alias("v")), lambda x: _without_suffix(x["t"], x["v"])
    )


def _without_suffix(title: Column, value: Column) -> Column:
    t = F.rtrim(title)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(value))
    hit = (
        (F.length(value) > 0)
        & F.endswith(F.lower(t), F.lower(value))
        & head.rlike(r"(?U),\s*$")
    )
    return F.when(F.coalesce(hit, F.lit(False)), strip(F.regexp_replace(head, r"(?U),\s*$", ""))).otherwise(title)


def bare_title(raw: Column | str, company: Column | str, grade: Column | str) -> Column:
    """Card title without reference number, place, company, grade and contract words."""
    raw, company, grade = _col(raw), _col(company), _col(grade)
    t = raw
    for pattern in (r",\s*#\d+\s*$", r",\s*kigali\s*,\s*rwanda\s*$", r",\s*rwanda\s*$", r",\s*kigali\s*$"):
        t = strip(F.regexp_replace(t, "(?i)" + pattern, ""))
    t = _drop_suffix(t, F.coalesce(company, F.lit("")))
    t = F.when(
        F.length(grade) > 0,
        strip(F.regexp_replace(t, F.concat(F.lit(r"(?i),\s*"), grade, F.lit(r"\b")), F.lit(""))),
    ).otherwise(t)
    for words in (
        "Fixed Term Position", "Fixed Term Appointment", "Fixed-Term", "Temporary Job Opening",
        "Individual Contractor",
    ):
        t = strip(F.regexp_replace(t, rf"(?i),\s*{words}\s*$", ""))
    return F.coalesce(clean(t), raw)


def title_without_company(title: Column | str, company: Column | str) -> Column:
    """Remove `` at Company`` wherever it stands."""
    title, company = _col(title), _col(company)
    quoted = F.concat(
        F.lit(r"(?i)\s+at\s+\Q"), F.replace(company, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )
    return F.when(
        F.length(company) > 0, strip(F.regexp_replace(title, quoted, F.lit("")))
    ).otherwise(title)


def organisation_and_deadline(c: Column | str) -> Column:
    """``Org | Closing Date: x`` -> struct(company, deadline)."""
    c = _col(c)
    rest = strip(F.regexp_extract(c, r"(?s)^[^|]*\|(.*)$", 1))
    return F.struct(
        F.coalesce(clean(F.substring_index(c, "|", 1)), F.lit("")).alias("company"),
        F.coalesce(
            clean(
                F.regexp_extract(
                    rest,
                    r"(?i)(?:deadline|closing date|application close|apply by|closes?)[:\s]+(.+?)(?:\s*\||$)",
                    1,
                )
            ),
            F.lit(""),
        ).alias("deadline"),
    )
