"""The daily job: pages to postings, insert-if-absent, duplicate removal, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.dates import days_ago, relative_day
from jobloom.operators import dedup, ingest, records, report, search
from jobloom.operators.pages import extract_cards, extract_details
from jobloom.operators.positions import split_positions
from jobloom.schema import POSTING_SCHEMA
from jobloom.sources.profiles import PROFILES, SourceProfile, build_postings
from jobloom.streaming.incremental import STORED_SCHEMA, ingest_batch

# detail fields that fill in for a stub field of the same name; the card wins for these
_CARD_FIRST = {"jobinrwanda": ("employment_raw", "deadline", "posted_date", "title", "company")}
_MERGED = (
    "title", "company", "description", "location_raw", "employment_raw", "education_raw",
    "experience_raw", "sector_raw", "salary_text", "category", "grade", "posted_date", "deadline",
    "source_job_id", "posted_age",
)


def source_postings(
    profile: SourceProfile, listing: DataFrame | None, posts: DataFrame | None, as_of: Column
) -> DataFrame:
    """Canonical postings of one board from its listing pages and posting pages.

    Links are made distinct before the detail join, so the wide detail rows meet each
    link once.  Boards without listing cards start from the posting pages.
    """
    details = extract_details(posts, profile) if posts is not None and profile.detail(F.col("html"), F.col("text")) else None
    if listing is not None:
        stubs = records.first_per_key(
            extract_cards(listing, profile), ["source_url"], [F.col("url"), F.col("pos")]
        ).drop("url", "pos")
        joined = records.attach_details(stubs, details) if details is not None else stubs
    else:
        joined = details
    card_first = _CARD_FIRST.get(profile.name, ())
    rules = {}
    for name in _MERGED:
        order = [name, f"d_{name}"] if name in card_first else [f"d_{name}", name]
        present = [c for c in order if c in joined.columns]
        if present:
            rules[name] = (present, "")
    raw = records.merge_fields(joined, rules)
    if "posted_age" in rules:
        raw = raw.withColumn("posted_date", relative_day("posted_age", as_of))
    elif profile.name == "greatrwandajobs":
        raw = raw.withColumn("posted_date", days_ago("posted_date", as_of))
    postings = build_postings(raw, profile, as_of)
    if profile.name == "mucuruzi":
        split = split_positions(postings).select(*[f.name for f in POSTING_SCHEMA])
        postings = records.first_by_hash(split, [F.col("source_url"), F.col("id")])
    return postings


@dataclass(frozen=True)
class RunResult:
    totals: DataFrame
    counts: DataFrame
    errors: dict[str, str]
    table: str


def run_pipeline(
    spark: SparkSession,
    pages: dict[str, tuple[DataFrame | None, DataFrame | None]],
    store: str,
    runs: str,
    clean_root: str,
    version: int,
    as_of: Column,
) -> RunResult:
    """Ingest all boards, remove duplicates into a new table version, return the totals.

    ``pages`` maps a board to its (listing pages, posting pages).  A board whose plan
    cannot be built is reported in ``errors`` and adds nothing.
    """
    empty = spark.createDataFrame([], POSTING_SCHEMA)
    batch, errors = records.union_sources(
        {
            name: (lambda n=name, p=pair: source_postings(PROFILES[n], *p, as_of))
            for name, pair in pages.items()
        },
        empty,
    )
    counts = ingest_batch(batch, store, runs, as_of)
    jobs = ingest.read_or_empty(spark, store, STORED_SCHEMA)
    scan = search.dedup_scan(jobs)
    lost = dedup.duplicate_leaders(scan).checkpoint()
    table = ingest.write_version(dedup.survivors(jobs, lost), clean_root, version)
    totals = report.pipeline_totals(counts, lost, spark.read.parquet(table).filter("is_active"))
    return RunResult(totals, counts, errors, table)
