"""Keyword and rule classifiers.

A keyword table becomes one constant array, longest keyword first, so the first
hit is the answer.  A long table is also one pattern, which a text is read with once;
in a short one ``aggregate`` stops testing after the hit because ``coalesce`` is lazy.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions.text import _col, let

SUBSTRING, BOUNDARY_RAW, BOUNDARY_STRIPPED = "substring", "boundary_raw", "boundary_stripped"
#: Needles from which one pattern is faster than one test each.
MANY = 48

def ranked(kmap: dict[str, list[str]], mode: str = SUBSTRING) -> list[tuple[str, str, bool]]:
    """(needle, category, bounded) in decision order: longer first, then category order."""
    out = []
    for order, (category, words) in enumerate(kmap.items()):
        for w in words:
            bounded = mode != SUBSTRING and len(w) <= 4
            needle = w
            if mode == BOUNDARY_STRIPPED:
                bounded = bounded or w.rstrip() in vocab.BOUNDARY_WORDS
                needle = w.strip() if bounded else w
            out.append((-len(w), order, needle, category, bounded))
    out.sort(key=lambda k: (k[0], k[1]))
    return [(needle, category, bounded) for _, _, needle, category, bounded in out]


def _constant_array(values: list[str]) -> Column:
    """A list of strings as one literal that the optimizer folds into a constant array."""
    return F.split(F.lit("\x02".join(values)), "\x02")


def _trie(words: list[str]) -> str:
    """A regex of all words that tells them apart letter by letter and tries longer ones first."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        if w:
            by_letter.setdefault(w[0], []).append(w[1:])
    one_of = _one_of({c: re.escape(c) + _trie(rest) for c, rest in sorted(by_letter.items())})
    return one_of if "" not in words else f"(?:{one_of}|)" if by_letter else ""


def _one_of(by_letter: dict[str, str]) -> str:
    """Alternatives that begin with different letters; many are halved by a look at the letter."""
    letters, branches = list(by_letter), list(by_letter.values())
    if len(letters) < 2:
        return "".join(branches)
    if len(letters) < 4:
        return f"(?:{'|'.join(branches)})"
    half = len(letters) // 2
    low, high = ({c: by_letter[c] for c in some} for some in (letters[:half], letters[half:]))
    return f"(?:(?={_class(low)}){_one_of(low)}|{_one_of(high)})"


def _class(letters) -> str:
    return f"[{''.join(map(re.escape, letters))}]"


def _first_place(text: Column, needles: list[str]) -> Column:
    """Place (from 1) of the first needle contained in the text, null if none is.

    Many needles, none before one that it begins, are one pattern: it finds the first of them
    that begins at each character, and the least of these counts.
    """
    table = _constant_array(needles)
    if len(needles) >= MANY and not any(b.startswith(a) for i, a in enumerate(needles) for b in needles[i + 1 :] if a != b):
        found = F.regexp_extract_all(text, F.lit(f"(?=({_trie(list(dict.fromkeys(needles)))}))"), 1)
        return F.array_min(F.transform(found, lambda x: F.array_position(table, x))).cast("int")

    def pick(h: Column) -> Column:
        return F.aggregate(
            table,
            F.lit(None).cast("string"),
            lambda found, k: F.coalesce(found, F.when(F.contains(h, k), k)),
        )

    return F.array_position(table, let(text, pick)).cast("int")


def _first_bounded(text: Column, needles: list[str]) -> Column:
    """The same of needles that stand between word boundaries; the first listed that begins at a character."""
    begins = _class(sorted({n[0] for n in needles}))
    any_of = "|".join(re.escape(n) for n in dict.fromkeys(needles))
    found = F.regexp_extract_all(text, F.lit(rf"(?={begins})(?U)\b(?=({any_of})\b)"), 1)
    table = _constant_array(needles)
    return F.array_min(F.transform(found, lambda x: F.array_position(table, x))).cast("int")


def _first_in(haystack: Column, needles: list[str], values: list[str]) -> Column:
    """The value of the first needle contained in the text, null if none is."""
    return F.try_element_at(_constant_array(values), _first_place(F.lower(haystack), needles))


def _first_hit(haystack: Column, kmap: dict[str, list[str]], mode: str) -> Column:
    table = ranked(kmap, mode)

    def place(bounded: bool) -> Column:
        ranks = [(i, n) for i, (n, _, b) in enumerate(table) if b == bounded]
        if not ranks:
            return F.lit(None).cast("int")
        first = (_first_bounded if bounded else _first_place)(F.lower(haystack), [n for _, n in ranks])
        return F.try_element_at(_constant_array([str(i + 1) for i, _ in ranks]), first).cast("int")

    found = F.try_element_at(_constant_array([category for _, category, _ in table]), F.least(place(False), place(True)))
    return F.when(F.length(haystack) > 0, found)


def keyword_category(
    text: Column | str,
    kmap: dict[str, list[str]],
    title: Column | str | None = None,
    mode: str = SUBSTRING,
) -> Column:
    """Category of the longest keyword found in the title, else in the text; null if none."""
    found = _first_hit(_col(text), kmap, mode)
    if title is None:
        return found
    return F.coalesce(_first_hit(_col(title), kmap, mode), found)


def _any(text: Column, words: list[str]) -> Column:
    """True if any of the literal words occurs."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def first_match_sector(category: Column | str, title: Column | str) -> Column:
    """First key of the ordered map contained in ``category title``; ``Other`` if none."""
    text = F.concat_ws(" ", F.coalesce(_col(category), F.lit("")), F.coalesce(_col(title), F.lit("")))
    rules = vocab.SECTOR_FIRST_MATCH
    return F.coalesce(_first_in(text, list(rules), list(rules.values())), F.lit("Other"))


def level_from_title(title: Column | str) -> Column:
    t = F.lower(F.coalesce(_col(title), F.lit("")))
    return (
        F.when(_any(t, vocab.TITLE_SENIOR_WORDS), "Senior")
        .when(_any(t, vocab.TITLE_JUNIOR_WORDS), "Junior")
        .otherwise("Mid-Level")
    )


def employment_from_label(label: Column | str) -> Column:
    t = F.lower(F.coalesce(_col(label), F.lit("")))
    return (
        F.when(_any(t, ["full-time", "full time"]), "Full-time")
        .when(_any(t, ["part-time", "part time"]), "Part-time")
        .when(F.contains(t, F.lit("temporary")), "Temporary")
        .when(F.contains(t, F.lit("freelance")), "Freelance")
        .when(F.contains(t, F.lit("internship")), "Internship")
        .when(_any(t, ["contract", "consultancy"]), "Contract")
        .otherwise("Full-time")
    )


# --- fixed values: UN grade tokens ------------------------------------------
UN_GRADE = r"(?i)\b(P[1-6]|G[1-7]|D[12]|NO-?[A-D1-4]|ASG|USG|FS-\d)\b"
UN_GRADE_LEVELS = [
    (r"(?i)\bP[12]\b|\bG[1-5]\b|\bNO-?[AB12]\b", "Entry"),
    (r"(?i)\bP3\b|\bNO-?[CD34]\b", "Mid"),
    (r"(?i)\bP[456]\b", "Senior"),
    (r"(?i)\bD[12]\b|\bASG\b|\bUSG\b", "Executive"),
]


def un_grade(text: Column | str) -> Column:
    return F.upper(F.regexp_extract(_col(text), UN_GRADE, 1))


def un_grade_level(text: Column | str) -> Column:
    """Level of the first grade pattern that occurs; ``''`` if none."""
    t = F.coalesce(_col(text), F.lit(""))
    out = None
    for pattern, level in UN_GRADE_LEVELS:
        out = F.when(t.rlike(pattern), level) if out is None else out.when(t.rlike(pattern), level)
    return out.otherwise("")


def phrase_grade_level(grade: Column | str, mode: str = BOUNDARY_STRIPPED) -> Column:
    """Level named by a grade phrase, else the keyword level; ``''`` if none."""
    g = F.lower(F.coalesce(_col(grade), F.lit("")))
    return F.coalesce(
        F.when(_any(g, ["junior level", "administrative support", "entry level"]), "Entry")
        .when(_any(g, ["mid level"]), "Mid")
        .when(_any(g, ["senior level", "managerial level"]), "Senior")
        .when(_any(g, ["executive level", "director level"]), "Executive")
        .when(_any(g, ["internship", "intern level"]), "Internship"),
        keyword_category(g, vocab.LEVEL, mode=mode),
        F.lit(""),
    )


def phrase_grade_employment(grade: Column | str) -> Column:
    g = F.trim(F.lower(F.coalesce(_col(grade), F.lit(""))))
    return (
        F.when((g == "con") | _any(g, ["consultant", "consultancy", "contractor"]), "Consultancy")
        .when(_any(g, ["volunteer", "unv"]), "Volunteer")
        .when(g.rlike(r"(?U)\bintern\b") | _any(g, ["internship", "attachment"]), "Internship")
        .otherwise("Contract")
    )


def un_employment(raw: Column | str) -> Column:
    """Employment type by priority; fixed-term contract when nothing is said."""
    t = F.lower(F.coalesce(_col(raw), F.lit("")))
    return (
        F.when(_any(t, ["individual contractor", "consultancy", "consultant", "freelance"]), "Consultancy")
        .when(_any(t, ["volunteer", "unv", "voluntary"]), "Volunteer")
        .when(_any(t, ["intern", "attachment", "apprentice"]), "Internship")
        .when(_any(t, ["part-time", "part time"]), "Part-time")
        .when(_any(t, ["permanent", "indefinite", "full-time", "full time"]), "Full-time")
        .otherwise("Contract")
    )


def employment_bucket(employment: Column | str) -> Column:
    """The seven report buckets for employment types."""
    t = F.lower(_col(employment))
    return (
        F.when(_any(t, ["full", "permanent"]), "Full-time/Permanent")
        .when(F.contains(t, F.lit("contract")), "Contract")
        .when(F.contains(t, F.lit("consult")), "Consultancy")
        .when(F.contains(t, F.lit("intern")), "Internship")
        .when(F.contains(t, F.lit("volunteer")), "Volunteer")
        .when(F.contains(t, F.lit("tender")), "Tender")
        .otherwise("Others")
    )


def employment_from_category(category: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.CATEGORY_EMPLOYMENT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _col(category)), F.lit("Contract"))


def has_value(c: Column | str) -> Column:
    """Report filter: known, not empty and not the word EMPTY."""
    c = _col(c)
    return F.coalesce((c != "") & (F.upper(c) != "EMPTY"), F.lit(False))
