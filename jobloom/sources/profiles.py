"""Source profiles: what differs between boards, as data and field expressions.

A profile says how a card and a posting page are cut up (``card``, ``stub``,
``detail``) and how the merged raw fields become a canonical record (``classify``).
A new board is a new profile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions import classify as C
from jobloom.functions import dates as D
from jobloom.functions import extract as X
from jobloom.functions import html as H
from jobloom.functions import text as T
from jobloom.schema import enforce

Fields = dict[str, Column]
# raw columns a classifier may read after the merge
RAW = (
    "title", "company", "description", "location_raw", "employment_raw", "education_raw",
    "experience_raw", "sector_raw", "salary_text", "category", "grade", "posted_date", "deadline",
    "source_url", "source_job_id",
)


@dataclass(frozen=True)
class SourceProfile:
    name: str
    base_url: str
    listed_on: str
    # listing pages
    card: str = r"(?is)<article\b[^>]*>.*?</article\s*>"
    card_group: int = 0
    stub: Callable[[Column, Column], Fields] = field(default=lambda card, url: {})
    # posting pages
    boilerplate: Sequence[str] = H.BOILERPLATE
    detail: Callable[[Column, Column], Fields] = field(default=lambda html, text: {})
    # record
    districts: Sequence[str] = tuple(vocab.DISTRICTS)
    remote_words: Sequence[str] = ("remote",)
    sector: dict = field(default_factory=lambda: vocab.SECTOR)
    employment: dict = field(default_factory=lambda: vocab.EMPLOYMENT)
    education: dict = field(default_factory=lambda: vocab.EDUCATION)
    mode: str = C.SUBSTRING
    strict_salary: bool = True
    disqualifiers: Sequence[str] = tuple(vocab.DISQUALIFIERS_FULL)
    remote_reason: str = "Remote job - open globally"
    clause_reason: str = "Disqualifying clause: '%s'"
    country_reason: str = "Explicitly mentions Rwanda location"
    default_score: int = 3
    classify: Callable[["SourceProfile"], Fields] = field(default=lambda p: {})

    def keyword(self, text: Column, kmap: dict, title: bool = False) -> Column:
        return C.keyword_category(text, kmap, F.col("title") if title else None, self.mode)


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _or_empty(*cols: Column) -> Column:
    return T.first_nonempty(*cols, default="")


# --- record recipes ---------------------------------------------------------


def _recipe_detailed(p: SourceProfile) -> Fields:
    """Boards with a fact list on the posting page."""
    combo = T.join_nonempty("title", "description", "sector_raw")
    return {
        "sector": _or_empty(p.keyword(combo, p.sector, True), T.clean("sector_raw")),
        "employment_type": _or_empty(
            p.keyword(_c("employment_raw"), p.employment, True),
            p.keyword(combo, p.employment),
            T.clean("employment_raw"),
        ),
        "job_level": _or_empty(
            p.keyword(F.concat_ws(" ", _c("experience_raw"), _c("description")), vocab.LEVEL, True)
        ),
        "education_level": _or_empty(
            p.keyword(_c("education_raw"), p.education),
            p.keyword(_c("description"), p.education),
            T.clean("education_raw"),
        ),
        "experience_years": X.experience_years(T.join_nonempty("experience_raw", "description")),
    }


def _recipe_feed(p: SourceProfile) -> Fields:
    combo = T.join_nonempty("title", "description", "employment_raw")
    return {
        "sector": _or_empty(p.keyword(combo, p.sector, True)),
        "employment_type": _or_empty(
            p.keyword(_c("employment_raw"), p.employment, True),
            p.keyword(combo, p.employment),
            T.clean("employment_raw"),
        ),
        "job_level": _or_empty(p.keyword(combo, vocab.LEVEL, True)),
        "education_level": _or_empty(p.keyword(_c("description"), p.education)),
        "experience_years": X.experience_years("description"),
    }


def _recipe_description(p: SourceProfile) -> Fields:
    """Boards where the description is the only text; a site label outranks keywords."""
    text = _c("description")
    return {
        "sector": _or_empty(p.keyword(text, p.sector, True)),
        "employment_type": _or_empty(T.clean("employment_raw"), p.keyword(text, p.employment, True)),
        "job_level": _or_empty(p.keyword(text, vocab.LEVEL, True)),
        "education_level": _or_empty(p.keyword(text, p.education)),
        "experience_years": X.experience_years(text),
    }


def _recipe_announcement(p: SourceProfile) -> Fields:
    text = _c("description")
    return {
        **_recipe_description(p),
        "employment_type": _or_empty(p.keyword(text, p.employment, True)),
        "deadline": _or_empty(F.col("deadline"), X.stated_deadline(text)),
    }


def _recipe_daily(p: SourceProfile) -> Fields:
    found = _recipe_description(p)
    tender = F.when(F.contains(_c("category"), F.lit("tenders")), "Tender")
    return {**found, "sector": _or_empty(found["sector"], tender)}


def _recipe_portal(p: SourceProfile) -> Fields:
    found = _recipe_description(p)
    tender = F.contains(F.lower(_c("category")), F.lit("tender"))
    return {**found, "sector": F.when(tender, "Tender").otherwise(found["sector"])}


def _recipe_un(p: SourceProfile) -> Fields:
    combo = T.join_nonempty("title", "description", "company")
    return {
        "sector": T.first_nonempty(p.keyword(combo, p.sector, True), default="NGO"),
        "job_level": _or_empty(
            C.un_grade_level("grade"), C.un_grade_level("description"), p.keyword(combo, vocab.LEVEL, True)
        ),
        "employment_type": C.un_employment("description"),
        "education_level": _or_empty(p.keyword(combo, p.education)),
        "experience_years": X.experience_years(combo),
    }


def _recipe_pool(p: SourceProfile) -> Fields:
    combo = T.join_nonempty("title", "description", "grade")
    return {
        "sector": T.first_nonempty(p.keyword(combo, p.sector, True), default="NGO"),
        "job_level": _or_empty(C.phrase_grade_level("grade"), p.keyword(combo, vocab.LEVEL, True)),
        "employment_type": C.phrase_grade_employment("grade"),
        "education_level": _or_empty(p.keyword(_c("description"), p.education)),
        "experience_years": X.experience_years("description"),
    }


def _recipe_category(p: SourceProfile) -> Fields:
    combo = T.join_nonempty("title", "description")
    return {
        "sector": _or_empty(p.keyword(combo, p.sector, True)),
        "job_level": _or_empty(p.keyword(combo, vocab.LEVEL, True)),
        "employment_type": T.first_nonempty(
            p.keyword(_c("employment_raw"), p.employment), C.employment_from_category("category")
        ),
        "education_level": _or_empty(
            p.keyword(_c("education_raw"), p.education),
            p.keyword(_c("description"), p.education),
            T.clean("education_raw"),
        ),
        "experience_years": _or_empty(
            X.experience_years("experience_raw"), X.experience_years("description")
        ),
    }


def _recipe_web(p: SourceProfile) -> Fields:
    named = X.named_district("location_raw")
    return {
        "sector": C.first_match_sector(F.lit(""), "title"),
        "job_level": C.level_from_title("title"),
        "employment_type": F.when(
            T.nonempty("employment_raw").isNotNull(), C.employment_from_label("employment_raw")
        ).otherwise(""),
        "education_level": F.lit(""),
        "experience_years": F.lit(""),
        "district": named["district"],
        "rwanda_eligible": F.lit(True),
        "eligibility_reason": F.lit(p.listed_on),
        "confidence_score": F.lit(5),
    }


def _recipe_government(p: SourceProfile) -> Fields:
    return {
        "id": T.identity(F.lit(p.name + "_"), "title"),
        "duplicate_hash": T.identity("title", "company"),
        "sector": F.lit("Government"),
        "job_level": F.lit(""),
        "district": F.lit("Kigali"),
        "location_raw": F.lit(""),
        "is_remote": F.lit(False),
        "employment_type": T.first_nonempty("employment_raw", default="Contract"),
        "education_level": _c("education_raw"),
        "experience_years": F.lit(""),
        "rwanda_eligible": F.lit(True),
        "eligibility_reason": F.lit(p.listed_on),
        "confidence_score": F.lit(5),
    }


# --- card and page readers --------------------------------------------------


def _href(card: Column, base: str, attr: str | None = None) -> Column:
    return T.resolve(base, H.attribute(card, "a", "href", attr))


def _stub_cards(card: Column, url: Column) -> Fields:
    base = "https://www.jobinrwanda.com"
    link = _href(card, base)
    meta = H.element_text(card, "p", r"""class\s*=\s*["'][^"']*card-text""")
    employer = H.attribute(H.element(card, "p", r"""class\s*=\s*["'][^"']*card-text"""), "a", "href")
    return {
        "source_url": link,
        "source_job_id": T.slug(link),
        "title": H.element_text(card, "span", "field--name-title"),
        "company": T.company_from_slug(employer),
        "experience_raw": T.capture(meta, r"Experience[:\s]+([^|]+?)(?:\s*\||\s*Published|$)"),
        "posted_date": T.capture(meta, r"Published[:\s]+([^|]+?)(?:\s*\||$)"),
        "deadline": F.coalesce(
            H.element_text(card, "time"), T.capture(meta, r"Deadline[:\s]+(.+?)(?:\s*\||$)")
        ),
        "employment_raw": H.element_text(card, "span", "badge"),
        "location_raw": F.coalesce(
            T.capture(meta, r"\|\s*([A-Za-z][A-Za-z\s,]+?)\s*\|.*?Published"), X.labelled(meta, "Location")
        ),
    }


def _detail_facts(html: Column, text: Column) -> Fields:
    facts = H.element_text(html, "ul", "list-group")
    return {
        "sector_raw": X.labelled(facts, "Sector"),
        "employment_raw": X.labelled(facts, "Contract type"),
        "positions_count": T.capture(facts, r"Positions[:\s]+(\d+)"),
        "location_raw": X.labelled(facts, "Location"),
        "education_raw": X.labelled(facts, "Education"),
        "experience_raw": X.labelled(facts, "Experience"),
        "description": H.element_text(html, "div", "field--name-field-job-full-description"),
        "application_link": H.attribute(H.element(html, "li", "job-apply-btn"), "a", "href"),
        "salary_text": X.around_first(text, "salary|compensation|remuneration|pay|stipend", 30, 80),
    }


def _stub_daily(card: Column, url: Column) -> Fields:
    base = "https://jobs.newtimes.co.rw"
    link = _href(card, base, r"""href\s*=\s*["'][^"']*/jobs/""")
    text = H.text_of(card)
    core = T.strip(F.regexp_replace(text, r"(?is)\|?\s*published\s+on.+", ""))
    core = T.strip(F.regexp_replace(core, r"(?is)\|?\s*deadline.+", ""))
    pair, dates = T.role_at_company(core), D.published_and_deadline(text)
    tender = F.contains(url, F.lit("tenders"))
    return {
        "source_url": link,
        "source_job_id": T.leading_id(link),
        "title": pair["title"],
        "company": pair["company"],
        "posted_date": dates["posted_date"],
        "deadline": dates["deadline"],
        "location_raw": H.element_text(card, r"\w+", r"""class\s*=\s*["'][^"']*location"""),
        "employment_raw": F.coalesce(
            H.element_text(card, "span", r"""class\s*=\s*["'][^"']*(?:badge|tag|type)"""),
            F.when(tender, "Tender"),
        ),
        "category": F.when(tender, "tenders").otherwise(""),
    }


def _detail_daily(html: Column, text: Column) -> Fields:
    dates = D.published_and_deadline(text)
    return {
        "title": H.element_text(html, "h1"),
        "company": T.capture(text, r"\bat\s+([A-Z][A-Za-z0-9\s&.()]+?)\s*\|"),
        "location_raw": H.element_text(html, r"\w+", r"""class\s*=\s*["'][^"']*location"""),
        "description": H.describe(html, text),
        "posted_date": dates["posted_date"],
        "deadline": dates["deadline"],
        "application_link": H.apply_link(html, ("apply", "submit application"), "https://jobs.newtimes.co.rw"),
    }


def _stub_portal(card: Column, url: Column) -> Fields:
    base = "https://www.greatrwandajobs.com"
    link = _href(card, base, r"""href\s*=\s*["'][^"']*/jobs/job-detail/""")
    text = H.text_of(card)
    alt = T.strip(H.attribute(card, "img", "alt"))
    named = F.when((F.length(alt) > 2) & ~F.contains(F.lower(alt), F.lit("logo")), alt)
    employer = r"""href\s*=\s*["'][^"']*/jobs/company-detail/"""
    return {
        "source_url": link,
        "source_job_id": T.trailing_id(link),
        "title": H.element_text(card, "a", r"""href\s*=\s*["'][^"']*/jobs/job-detail/"""),
        "company": F.coalesce(named, H.element_text(card, "a", employer)),
        "category": X.labelled(text, "Job Category"),
        "employment_raw": T.capture(text, "(Full-time|Part-time|Contract|Internship|Volunteer|Consultancy)"),
        # the day the page was read is the page's own column, so age is resolved at build time
        "posted_date": X.labelled(text, "Posted", ("Deadline of this Job", "Deadline", "Duty Station")),
        "deadline": D.loose_deadline(X.labelled(text, "Deadline of this Job", ("Duty Station",))),
        "location_raw": T.capture(text, r"Duty Station:\s*(.+?)$"),
    }


def _detail_portal(html: Column, text: Column) -> Fields:
    body = r"""(?:jsjobsview|job-description|jobdesc|jsjobs_job_description|item-page|jd_inner)"""
    return {
        "company": H.company_of(html, text),
        "description": F.coalesce(H.element_text(html, "div", body), H.element_text(html, "main|article")),
        "application_link": H.apply_link(
            html, ("apply now", "apply here", "submit application", "click to apply"),
            "https://www.greatrwandajobs.com",
        ),
    }


def _stub_feed(card: Column, url: Column) -> Fields:
    base = "https://rw.jobskazi.com"
    link = _href(card, base)
    items = F.transform(H.elements(H.element(card, "ul"), "li"), H.text_of)

    def item(i: int, default: str) -> Column:
        return F.coalesce(F.get(items, F.lit(i)), F.lit(default))

    return {
        "source_url": link,
        "source_job_id": T.slug(link),
        "title": H.element_text(card, "h3"),
        "company": T.first_nonempty(item(1, ""), H.attribute(card, "img", "alt"), default=""),
        "location_raw": T.first_nonempty(item(0, ""), default="Kigali (Rwanda)"),
        "employment_raw": T.squeeze(F.concat_ws(" ", item(2, "Contract"), item(3, "Full Time"))),
        "posted_age": T.capture(H.text_of(card), r"(posted\s+\d+[^<]*?ago)"),
    }


def _detail_feed(html: Column, text: Column) -> Fields:
    body = H.element_text(html, "div", r"""class\s*=\s*["'][^"']*(?:job.description|job.content|entry-content)""")
    strong = F.filter(
        F.transform(H.elements(html, "strong"), H.text_of),
        lambda s: F.length(s).between(1, 99) & ~F.contains(F.lower(s), F.lit("apply")),
    )
    meta = F.lower(H.element_text(html, "ul", "job-listing-meta"))
    return {
        "company": F.get(strong, F.lit(0)),
        "description": body,
        "location_raw": H.element_text(html, "a", r"maps\.google\.com"),
        "employment_raw": F.when(meta.rlike("full.time"), "Full-time")
        .when(meta.rlike("part.time"), "Part-time")
        .when(F.contains(meta, F.lit("contract")), "Contract"),
        "posted_age": T.capture(text, r"(posted\s+\d+\s+\w+)"),
        "deadline": X.numeric_deadline(body),
        "salary_text": X.around_first(text, "salary|compensation|remuneration|pay|stipend", 30, 80),
    }


def _stub_un(card: Column, url: Column) -> Fields:
    base = "https://unjobs.org"
    raw = H.element_text(card, "a", "jtitle")
    link = _href(card, base, "jtitle")
    after = H.text_of(F.regexp_extract(card, r"(?is)</a\s*>\s*<br\s*/?>([^<]*)", 1))
    pair, grade = T.organisation_and_deadline(after), C.un_grade(raw)
    return {
        "source_url": link,
        "source_job_id": T.slug(link),
        "title": T.bare_title(raw, pair["company"], grade),
        "company": pair["company"],
        "description": raw,
        "grade": grade,
        "location_raw": F.lit("Kigali, Rwanda"),
        "deadline": pair["deadline"],
        "salary_text": raw,
    }


def _stub_pool(card: Column, url: Column) -> Fields:
    base = "https://www.impactpool.org"
    logo = T.clean(H.attribute(card, "img", "alt", r"""src\s*=\s*["'][^"']*(?:logo|cdn)"""))
    link = _href(card, base)
    lines = F.filter(
        H.lines_of(card),
        lambda x: ~F.lower(x).isin("closing today", "closing soon")
        & F.coalesce(F.lower(x) != F.lower(logo), F.lit(True)),
    )
    shift = F.when(logo.isNotNull(), 0).otherwise(1)
    return {
        "source_url": link,
        "source_job_id": T.slug(link),
        "title": F.get(lines, F.lit(0)),
        "company": F.coalesce(logo, F.get(lines, F.lit(1)), F.lit("")),
        "location_raw": X.preferred_place(F.coalesce(F.get(lines, shift + 1), F.lit(""))),
        "grade": F.coalesce(F.get(lines, shift + 2), F.lit("")),
    }


def _detail_pool(html: Column, text: Column) -> Fields:
    named = H.element_text(html, "title")
    posted = T.capture(text, r"(?:posted|published)[:\s]+(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})")
    return {
        "title": H.element_text(html, "h1"),
        "company": T.clean(F.get(F.split(named, r"\|"), F.lit(1))),
        "deadline": T.capture(text, r"application deadline[:\s]+(\w+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+\w+\s+\d{4})"),
        "description": F.coalesce(H.element_text(html, "main|article"), text),
        "posted_date": F.concat(F.lit("on "), posted),
        "salary_text": X.around_first(text, "salary|remuneration|compensation|pay scale", 30, 100),
    }


def _stub_category(card: Column, url: Column) -> Fields:
    base = "https://jobnziza.com"
    href = H.attribute(card, "a", "href", "read_job_post")
    link, text = T.resolve(base, href), H.text_of(card)
    alt = H.attribute(card, "img", "alt")
    return {
        "source_url": link,
        "source_job_id": F.coalesce(T.query_value(href, "slug"), T.slug(link)),
        "title": H.element_text(card, "h5"),
        "company": F.coalesce(H.element_text(card, "h6"), T.clean(F.replace(alt, F.lit("logo"), F.lit("")))),
        "category": F.coalesce(T.query_value(url, "category"), F.lit("")),
        "location_raw": F.coalesce(X.labelled(text, "Location"), F.lit("Rwanda")),
        "posted_date": D.slashed_day(T.capture(text, r"Published[:\s*]+(\d{2}/\d{2}/\d{4})")),
        "deadline": D.slashed_day(T.capture(text, r"Deadline[:\s*]+(\d{2}/\d{2}/\d{4})")),
    }


def _detail_category(html: Column, text: Column) -> Fields:
    body = r"""class\s*=\s*["'][^"']*(?:job|description|content|body)"""
    return {
        "title": H.element_text(html, "h4"),
        "company": H.element_text(html, "h5"),
        "location_raw": X.labelled(text, "Location"),
        "employment_raw": X.labelled(text, "Type"),
        "education_raw": X.labelled(text, "Education"),
        "experience_raw": X.labelled(text, "Experience"),
        "posted_date": T.nonempty(D.slashed_day(T.capture(text, r"Posted[:\s]+(\d{2}/\d{2}/\d{4})"))),
        "deadline": T.nonempty(D.slashed_day(T.capture(text, r"Deadline[:\s]+(\d{2}/\d{2}/\d{4})"))),
        "description": F.coalesce(H.element_text(html, "div|section", body), text),
        "salary_text": X.around_first(text, "salary|remuneration|compensation|pay", 20, 100),
    }


def _detail_announcement(html: Column, text: Column) -> Fields:
    head = T.announcement_title(H.element_text(html, "h1"))
    body = H.element(html, "div", r"""class\s*=\s*["'][^"']*(?:entry-content|post-content)""")
    # line breaks are kept: the position splitter reads lines
    lines = F.array_join(H.lines_of(body), "\n")
    return {
        "title": head["title"],
        "company": head["company"],
        "deadline": head["deadline"],
        "positions_count": head["positions_count"],
        "description": lines,
        "location_raw": X.stated_place(lines),
        "posted_date": F.coalesce(H.attribute(html, "time", "datetime"), H.attribute(html, "meta", "content", "article:published_time")),
        "application_link": H.apply_link(
            body, ("apply", "submit", "click here", "application"), "https://mucuruzi.com", mailto=False
        ),
        "salary_text": lines,
    }


def _stub_web(card: Column, url: Column) -> Fields:
    strong = H.element(card, "strong")
    link = H.attribute(strong, "a", "href")
    pair = T.role_at_company(H.element_text(strong, "a"))
    kinds = F.filter(
        F.transform(H.elements(card, "span"), H.text_of),
        lambda s: s.isin("Full-Time", "Part-Time", "Internship", "Temporary", "Freelance"),
    )
    text = H.text_of(card)
    return {
        "source_url": link,
        "source_job_id": T.last_segment(link),
        "title": pair["title"],
        "company": pair["company"],
        "employment_raw": F.get(kinds, F.lit(0)),
        "location_raw": X.labelled(text, "Location", ("Date",)),
        "posted_date": D.slashed_month_name(F.regexp_extract(text, r"(\d{1,2}/\w{3}/\d{4})", 1)),
    }


# --- the boards; names, hosts and reasons are fixed values ------------------
_WIDE_REMOTE = ("remote", "home-based", "home based")
_TWO_REASONS = dict(
    disqualifiers=tuple(vocab.DISQUALIFIERS_SHORT),
    remote_reason="Remote - open globally",
    country_reason="Explicitly mentions Rwanda",
)

PROFILES: dict[str, SourceProfile] = {
    p.name: p
    for p in [
        SourceProfile(
            "jobinrwanda", "https://www.jobinrwanda.com", "Listed on jobinrwanda.com",
            card=r"""(?is)<div\s[^>]*class\s*=\s*["']card["'].*?(?=<div\s[^>]*class\s*=\s*["']card["']|$)""",
            stub=_stub_cards, detail=_detail_facts, classify=_recipe_detailed,
        ),
        SourceProfile(
            "newtimesjobs", "https://jobs.newtimes.co.rw", "Listed on jobs.newtimes.co.rw",
            card=r"""(?is)<(?:div|li|article)\s[^>]*class\s*=\s*["'][^"']*(?:job|listing|card)[^"']*["'].*?</(?:div|li|article)\s*>""",
            stub=_stub_daily, detail=_detail_daily, classify=_recipe_daily,
            districts=tuple(vocab.DISTRICTS_SHORT), sector=vocab.sector_with_tender(vocab.TENDER_DAILY),
            employment=vocab.EMPLOYMENT_TOR, education=vocab.EDUCATION_LOCAL, strict_salary=False,
            clause_reason="Disqualifying: '%s'", **_TWO_REASONS,
        ),
        SourceProfile(
            "greatrwandajobs", "https://www.greatrwandajobs.com", "Listed on greatrwandajobs.com",
            card=r"""(?is)<div\s[^>]*class\s*=\s*["'][^"']*job[^"']*["'].*?(?=<div\s[^>]*class\s*=\s*["'][^"']*job|$)""",
            stub=_stub_portal, detail=_detail_portal, classify=_recipe_portal,
            districts=tuple(vocab.DISTRICTS_CITY_AREAS), sector=vocab.sector_with_tender(vocab.TENDER_PORTAL),
            employment=vocab.EMPLOYMENT_TOR, education=vocab.EDUCATION_LOCAL, strict_salary=False,
            clause_reason="Disqualifying: '%s'", **_TWO_REASONS,
        ),
        SourceProfile(
            "mucuruzi", "https://mucuruzi.com", "Listed on mucuruzi.com",
            detail=_detail_announcement, classify=_recipe_announcement,
            employment=vocab.EMPLOYMENT_TOR, education=vocab.EDUCATION_LOCAL, **_TWO_REASONS,
        ),
        SourceProfile(
            "mifotra", "https://recruitment.mifotra.gov.rw", "Rwanda Government Job",
            classify=_recipe_government,
        ),
        SourceProfile(
            "jobskazi", "https://rw.jobskazi.com", "Listed on jobskazi.com",
            card=r"""(?is)<li\s[^>]*class\s*=\s*["'][^"']*job_listing[^"']*["'].*?(?=<li\s[^>]*class\s*=\s*["'][^"']*job_listing|$)""",
            stub=_stub_feed, detail=_detail_feed, classify=_recipe_feed,
        ),
        SourceProfile(
            "unjobs", "https://unjobs.org", "Listed on unjobs.org Kigali duty station",
            card=r"""(?is)<div\s[^>]*class\s*=\s*["']job["'].*?</div\s*>""",
            stub=_stub_un, classify=_recipe_un, mode=C.BOUNDARY_RAW, remote_words=_WIDE_REMOTE,
            employment=vocab.EMPLOYMENT_UN, education=vocab.EDUCATION_UN,
            disqualifiers=tuple(vocab.DISQUALIFIERS_BASED), default_score=5,
        ),
        SourceProfile(
            "impactpool", "https://www.impactpool.org", "Listed on impactpool.org Rwanda page",
            card=r"""(?is)<a\s[^>]*href\s*=\s*["'][^"']*/jobs/\d+[^"']*["'].*?</a\s*>""",
            stub=_stub_pool, boilerplate=("nav", "footer", "header", "script", "style"),
            detail=_detail_pool, classify=_recipe_pool, mode=C.BOUNDARY_STRIPPED,
            remote_words=_WIDE_REMOTE, employment=vocab.EMPLOYMENT_POOL, education=vocab.EDUCATION_UN,
            disqualifiers=tuple(vocab.DISQUALIFIERS_BASED), default_score=5,
        ),
        SourceProfile(
            "jobnziza", "https://jobnziza.com", "Listed on jobnziza.com",
            card=r"""(?is)<a\s[^>]*href\s*=\s*["'][^"']*read_job_post.*?(?=<a\s[^>]*href\s*=\s*["'][^"']*read_job_post|$)""",
            stub=_stub_category, detail=_detail_category, classify=_recipe_category,
            mode=C.BOUNDARY_STRIPPED, remote_words=_WIDE_REMOTE,
            employment=vocab.EMPLOYMENT_NO_SHORT_INTERN, education=vocab.EDUCATION_A2_MASTER,
            disqualifiers=tuple(vocab.DISQUALIFIERS_BASED), default_score=5,
        ),
        SourceProfile(
            "jobwebrwanda", "https://jobwebrwanda.com", "Listed on jobwebrwanda.com",
            card=r"(?is)<li\b[^>]*>\s*<strong\b.*?</li\s*>", stub=_stub_web, classify=_recipe_web,
        ),
    ]
}


def _given(raw: DataFrame) -> DataFrame:
    """All raw columns a classifier may read, missing ones empty, and the others of the input."""
    return raw.select(
        *[(F.col(n) if n in raw.columns else F.lit("").cast("string")).alias(n) for n in RAW],
        *[c for c in raw.columns if c not in RAW],
    )


def _facts(profile: SourceProfile) -> dict[str, tuple[str, Column]]:
    """Place and pay of a raw posting as the board reads them, each with a name for this way of reading."""
    strict, districts, words = profile.strict_salary, profile.districts, profile.remote_words
    place_from = _c("location_raw") if strict else T.first_nonempty("location_raw", F.substring("description", 1, 400), default="")
    way = md5(repr((strict, tuple(districts), tuple(words))).encode()).hexdigest()[:8]
    return {
        "place": (f"_place_{way}", X.place(place_from, districts, words)),
        "pay": (f"_pay_{'strict' if strict else 'loose'}", X.salary("salary_text" if strict else "description", strict)),
    }


def with_facts(raw: DataFrame, profiles: Iterable[SourceProfile]) -> DataFrame:
    """Raw postings with every place and pay that the boards read, boards that read alike sharing one.

    For raw postings that go to several boards; :func:`build_postings` adds what is missing.
    """
    return _given(raw).withColumns({n: c for p in profiles for n, c in _facts(p).values()})


def build_postings(
    raw: DataFrame, profile: SourceProfile, as_of: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """Merged raw fields to canonical records; missing raw columns count as empty.

    ``keep`` names columns the input already carries, such as ``source`` or ``is_active``.
    Three projections, no shuffle: place and salary first, then keywords, then eligibility.
    """
    given, facts = _given(raw), _facts(profile)
    placed = given.withColumns({n: c for n, c in facts.values() if n not in given.columns})
    place, pay = facts["place"][0], facts["pay"][0]
    base: Fields = {
        "id": T.identity("source_url"),
        "duplicate_hash": T.identity("source_url"),
        **{n: F.col(f"{place}.{n}") for n in ("location_raw", "district", "country", "is_remote", "is_hybrid")},
        **{n: F.col(f"{pay}.{n}") for n in ("salary_min", "salary_max", "currency", "salary_disclosed")},
        "source": F.lit(profile.name),
        "scraped_at": as_of,
        "last_checked": as_of,
        "is_active": F.lit(True),
    }
    own = profile.classify(profile)
    made = {n: c for n, c in {**base, **own}.items() if n not in keep}
    classified = placed.withColumns(made).drop(place, pay)
    if "rwanda_eligible" not in own:
        verdict = X.eligibility(
            "title", "description", "location_raw", "is_remote", profile.disqualifiers,
            profile.listed_on, profile.remote_reason, profile.clause_reason,
            profile.country_reason, profile.default_score,
        )
        classified = classified.withColumn("_v", verdict).withColumns(
            {n: F.col(f"_v.{n}") for n in ("rwanda_eligible", "eligibility_reason", "confidence_score")}
        )
    return enforce(classified)
