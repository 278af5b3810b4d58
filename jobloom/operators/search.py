"""Scans and the job search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.dates import days_left, end_of_day, microseconds_left
from jobloom.functions.text import strip

# fixed values: the columns of the search scan, and how many cards one step shows
SCAN_COLUMNS = [
    "id", "title", "company", "source", "sector", "district", "employment_type", "job_level",
    "experience_years", "education_level", "posted_date", "deadline", "scraped_at", "is_active",
    "source_url",
]
PAGE_STEP = 9


def newest_first() -> list[Column]:
    return [F.desc("scraped_at"), F.asc("id")]


def active_postings(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Active postings with the deadline moved to the day's end and the time left."""
    return (
        jobs.filter(F.col("is_active"))
        .select(*SCAN_COLUMNS)
        .withColumn("deadline", end_of_day("deadline"))
        .withColumn("micros_left", microseconds_left("deadline", as_of))
        .withColumn("days_to_deadline", days_left("deadline", as_of))
    )


def dedup_scan(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("is_active")).select(
        "id", "title", "company", "deadline", "source", "scraped_at"
    )


def live(df: DataFrame) -> DataFrame:
    """Deadline known and not passed."""
    return df.filter(F.col("days_to_deadline") >= 0)


@dataclass(frozen=True)
class Criteria:
    """Search form.  ``None`` switches a filter off; ``text`` is a regex unless ``literal``."""

    text: str | None = None
    literal: bool = False
    sector: str | None = None
    district: str | None = None
    source: str | None = None
    within_days: int | None = None
    districts: Sequence[str] = ()
    sector_terms: Sequence[str] = ()
    reset: bool = False


def _matches(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike("(?i)" + pattern), F.lit(False))


def search(df: DataFrame, c: Criteria) -> DataFrame:
    """Filter an :func:`active_postings` frame; reset drops every filter."""
    if c.reset:
        return df
    df = live(df)
    if c.text:
        p = re.escape(c.text) if c.literal else c.text
        df = df.filter(_matches("title", p) | _matches("company", p))
    for column in ("sector", "district", "source"):
        value = getattr(c, column)
        if value is not None:
            df = df.filter(F.col(column) == value)
    if c.within_days is not None:
        df = df.filter(F.col("days_to_deadline") <= c.within_days)
    if c.districts:
        df = df.filter(F.col("district").isin(list(c.districts)))
    if c.sector_terms:
        df = df.filter(_matches("sector", "|".join(c.sector_terms)))
    return df


def first_cards(df: DataFrame, shown: int = PAGE_STEP) -> DataFrame:
    """The newest ``shown`` rows; Spark runs it as a distributed top-k."""
    return df.orderBy(*newest_first()).limit(shown)


def result_counts(df: DataFrame, shown: int = PAGE_STEP) -> DataFrame:
    """total / shown / remaining of a search with ``shown`` cards on the page.

    Expired rows can only appear after a reset; they are skipped after the limit,
    so ``shown`` may be smaller than the page.
    """
    on_page = F.count_if(F.coalesce(F.col("micros_left") >= 0, F.lit(True)))
    return df.agg(F.count("*").alias("total")).select(
        "total",
        first_cards(df, shown).agg(on_page).scalar().alias("shown"),
        F.greatest(F.col("total") - shown, F.lit(0)).cast("bigint").alias("remaining"),
    )


def cards(df: DataFrame) -> DataFrame:
    """Label texts of job cards: badge, urgency class, deadline line, fallbacks."""
    seconds = F.col("micros_left") / F.lit(1_000_000)
    days = F.col("days_to_deadline")
    hours = F.floor((seconds % 86400) / 3600).cast("int")
    minutes = F.floor((seconds % 3600) / 60).cast("int")
    short_date = F.date_format("deadline", "MMM dd, yyyy")
    long_date = F.date_format("deadline", "MMM dd, yyyy hh:mm a")

    def known(name: str) -> Column:
        return F.coalesce((F.upper(name) != "EMPTY") & (strip(name) != ""), F.lit(False))

    badge = (
        F.when(seconds.isNull(), "No deadline")
        .when(seconds < 3600, F.format_string("🚨 %d minutes left!", F.floor(seconds / 60).cast("int")))
        .when(seconds < 86400, F.format_string("🚨 %dh %dm left!", hours, minutes))
        .when(days <= 2, F.format_string("🚨 %d days %dh left!", days, hours))
        .when(days <= 7, F.format_string("⏰ %d days left", days))
        .otherwise(F.format_string("✅ %d days left", days))
    )
    urgency = (
        F.when(days.isNull(), "badge-source")
        .when(days <= 2, "badge-urgent")
        .when(days <= 7, "badge-warning")
        .otherwise("badge-ok")
    )
    line = (
        F.when(seconds.isNull(), "No deadline specified")
        .when(seconds < 86400, F.concat(F.lit("Deadline: "), long_date))
        .otherwise(F.concat(F.lit("Deadline: "), short_date))
    )
    return df.filter(seconds.isNull() | (seconds >= 0)).select(
        "id",
        "title",
        "company",
        F.coalesce("sector", F.lit("General")).alias("sector_label"),
        F.coalesce("district", F.lit("Rwanda")).alias("district_label"),
        "source",
        F.when(known("education_level"), F.col("education_level")).otherwise("Not Specified").alias("education_label"),
        F.when(known("experience_years"), F.concat("experience_years", F.lit(" years")))
        .otherwise("Not Specified")
        .alias("experience_label"),
        badge.alias("badge"),
        urgency.alias("urgency"),
        line.alias("deadline_line"),
        "source_url",
    )
