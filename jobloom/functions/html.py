"""Pieces of raw HTML as column expressions.

Pages are read with regular expressions inside the scan stage: no parser state
leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import _col, clean, nonempty, resolve, squeeze

BOILERPLATE = ("nav", "footer", "header", "script", "style", "aside")
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape(c: Column | str) -> Column:
    c = _col(c)
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def drop_blocks(html: Column | str, tags: tuple[str, ...] = BOILERPLATE) -> Column:
    """Remove whole elements together with their content, and comments."""
    html = F.regexp_replace(_col(html), r"(?s)<!--.*?-->", " ")
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return html


def text_of(fragment: Column | str) -> Column:
    """Text of a fragment: tags out, entities decoded, blanks collapsed."""
    return squeeze(unescape(F.regexp_replace(_col(fragment), r"(?s)<[^>]*>", " ")))


def lines_of(fragment: Column | str) -> Column:
    """Non-empty text pieces between tags, in order."""
    pieces = F.split(F.regexp_replace(_col(fragment), r"(?s)<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(pieces, lambda p: squeeze(unescape(p))), lambda p: p != "")


def visible_text(html: Column | str, tags: tuple[str, ...] = BOILERPLATE) -> Column:
    return text_of(drop_blocks(html, tags))


def element(html: Column | str, tag: str, attr: str | None = None) -> Column:
    """Inner HTML of the first element; ``attr`` is a regex the opening tag must contain."""
    opening = rf"<(?:{tag})\b[^>]*?{attr}[^>]*>" if attr else rf"<(?:{tag})\b[^>]*>"
    return nonempty(F.regexp_extract(_col(html), rf"(?is){opening}(.*?)</(?:{tag})\s*>", 1))


def element_text(html: Column | str, tag: str, attr: str | None = None) -> Column:
    return clean(text_of(element(html, tag, attr)))


def elements(html: Column | str, tag: str, attr: str | None = None) -> Column:
    opening = rf"<(?:{tag})\b[^>]*?{attr}[^>]*>" if attr else rf"<(?:{tag})\b[^>]*>"
    return F.regexp_extract_all(_col(html), F.lit(rf"(?is){opening}(.*?)</(?:{tag})\s*>"), 1)


def attribute(html: Column | str, tag: str, name: str, attr: str | None = None) -> Column:
    """Value of an attribute of the first element whose tag has it (and matches ``attr``)."""
    also = rf"(?=[^>]*{attr})" if attr else ""
    return nonempty(
        unescape(
            F.regexp_extract(_col(html), rf"""(?is)<(?:{tag})\b{also}[^>]*?\b{name}\s*=\s*["']([^"']*)["']""", 1)
        )
    )


def links(html: Column | str) -> Column:
    """array<struct<href, text>> of all anchors, in page order."""
    html = _col(html)
    hrefs = F.regexp_extract_all(html, F.lit(LINK), 1)
    texts = F.regexp_extract_all(html, F.lit(LINK), 2)
    return F.zip_with(
        hrefs,
        texts,
        lambda h, t: F.struct(unescape(h).alias("href"), text_of(t).alias("text")),
    )


def apply_link(
    html: Column | str,
    words: tuple[str, ...],
    own_host: str,
    mailto: bool = True,
) -> Column:
    """First outgoing link whose text asks to apply, or ``mailto:``; ``''`` if none."""
    asks = "|".join(re.escape(w) for w in words)

    def wanted(link: Column) -> Column:
        outgoing = F.lower(link["text"]).rlike(asks) & ~F.startswith(link["href"], F.lit(own_host))
        return outgoing | F.startswith(link["href"], F.lit("mailto:")) if mailto else outgoing

    return F.coalesce(F.get(F.filter(links(html), wanted), F.lit(0))["href"], F.lit(""))


def last_page(html: Column | str, pattern: str = r"page=(\d+)") -> Column:
    """Largest page number the pager links to, null without pager."""
    numbers = F.transform(
        F.regexp_extract_all(_col(html), F.lit(pattern), 1), lambda n: n.try_cast("int")
    )
    return F.array_max(numbers)


def absolute(base_url: str, href: Column | str) -> Column:
    return resolve(base_url, href)


def describe(html: Column | str, text: Column | str) -> Column:
    """Description cascade: paragraphs of the content area, else the text after a date marker.

    Paragraph text of at most 150 characters or made of navigation words does not count.
    """
    html = _col(html)
    text = _col(text)
    area = drop_blocks(F.coalesce(element(html, "main|article"), F.lit("")))
    paragraphs = F.filter(
        F.transform(elements(area, "p"), text_of), lambda p: F.length(p) > 10
    )
    joined = F.array_join(paragraphs, " ")
    # fixed values: words of the navigation bar
    is_nav = F.substring(joined, 1, 150).rlike(
        "Category Announcement Internship|All Category Distance|5 Miles 10 Miles"
    )
    area_text = text_of(area)
    marker = F.regexp_instr(area_text, F.lit("Posted|Deadline|Published on"))
    after = nonempty(
        F.trim(F.regexp_extract(F.substring(area_text, marker, F.length(area_text)), r"(?s)^[^.]*\.(.*)$", 1))
    )
    page_marker = F.regexp_instr(text, F.lit("Posted|Sign up for Job Alerts"))
    rest = F.substring(text, page_marker + 100, F.length(text))
    return F.coalesce(
        F.when((F.length(joined) > 150) & ~is_nav, joined),
        F.when((F.length(area_text) > 500) & (marker > 1), after),
        F.when((F.length(text) > 600) & page_marker.between(2, 800) & (F.length(rest) > 200), rest),
        F.lit(""),
    )


def company_of(html: Column | str, text: Column | str) -> Column:
    """Company cascade: company link, company-classed element, label, image alt text."""
    html = _col(html)
    alts = F.filter(
        F.regexp_extract_all(html, F.lit(r"""(?is)<img\b[^>]*?\balt\s*=\s*["']([^"']*)["']"""), 1),
        lambda a: (F.length(F.trim(a)) > 2) & ~F.lower(a).rlike("logo|icon"),
    )
    link = r"""href\s*=\s*["'][^"']*/jobs/company-detail/"""
    named = r"""class\s*=\s*["'][^"']*company"""

    def long_enough(c: Column) -> Column:
        return F.when(F.length(c) > 2, c)

    return F.coalesce(
        long_enough(clean(attribute(html, "a", "title", link))),
        long_enough(element_text(html, "a", link)),
        long_enough(element_text(html, "div", named)),
        long_enough(element_text(html, "span", named)),
        clean(F.regexp_extract(text, r"(?i)Company(?:\s+Name)?:\s*([^\n|]{3,100})", 1)),
        F.trim(F.get(alts, F.lit(0))),
        F.lit(""),
    )
