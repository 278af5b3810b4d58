"""Counts, shares and summaries of the market report.

Every report aggregates first and ranks the few aggregated rows afterwards, so
the only shuffle carries partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.classify import employment_bucket, has_value
from jobloom.operators.search import live


def value_counts(df: DataFrame, column: str, top: int | None = None, alias: str = "count") -> DataFrame:
    """Rows per value, most frequent first, ties by value; null is no value, ``''`` is."""
    out = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias(alias))
        .orderBy(F.desc(alias), F.asc(column))
    )
    return out.limit(top) if top else out


def with_share(counts: DataFrame, alias: str = "count") -> DataFrame:
    """Share of the total, which is a scalar subquery over the aggregated rows."""
    total = counts.agg(F.sum(alias)).scalar()
    return counts.withColumn("share", F.col(alias) / total)


def by_sector(df: DataFrame, top: int | None = None) -> DataFrame:
    return value_counts(live(df), "sector", top)


def by_source(df: DataFrame, top: int | None = None) -> DataFrame:
    return value_counts(live(df), "source", top)


def by_district(df: DataFrame, top: int | None = None) -> DataFrame:
    return value_counts(df, "district", top)


def by_company(df: DataFrame, top: int = 10) -> DataFrame:
    return value_counts(df, "company", top)


def by_education(df: DataFrame) -> DataFrame:
    return value_counts(df.filter(has_value("education_level")), "education_level")


def by_level(df: DataFrame, top: int = 10) -> DataFrame:
    return value_counts(df.filter(has_value("job_level")), "job_level", top)


def by_employment_bucket(df: DataFrame) -> DataFrame:
    kept = df.filter(has_value("employment_type"))
    return value_counts(kept.select(employment_bucket("employment_type").alias("clean_type")), "clean_type")


def per_day(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    return (
        df.groupBy(F.to_date(column).alias("day"))
        .agg(F.count("*").alias("jobs"))
        .filter(F.col("day").isNotNull())
        .orderBy("day")
    )


def headline(df: DataFrame, as_of: Column) -> DataFrame:
    """Live postings, those added in the last three days, those ending within two days."""
    return live(df).agg(
        F.count("*").alias("total_live"),
        F.count_if(F.col("scraped_at") >= as_of - F.expr("INTERVAL 3 DAYS")).alias("new_3_days"),
        F.count_if(F.col("days_to_deadline") <= 2).alias("expiring_2_days"),
    )


def insight_cards(df: DataFrame) -> DataFrame:
    """Total postings, sectors and sources with live postings, size of the top-employer list."""
    is_live = F.col("days_to_deadline") >= 0
    return df.agg(
        F.count("*").alias("total"),
        F.count_distinct(F.when(is_live, F.col("sector"))).alias("sectors"),
        F.count_distinct(F.when(is_live, F.col("source"))).alias("sources"),
        F.least(F.count_distinct("company"), F.lit(10)).alias("top_employers"),
    )


def market_summary(df: DataFrame) -> DataFrame:
    """Largest sector, source and district with their counts; nulls when there is no data."""

    def largest(counts: DataFrame, column: str) -> Column:
        # the smallest (-count, value) pair is the largest count, ties by value
        pair = F.struct((-F.col("count")).alias("n"), F.col(column).alias("v"))
        return counts.agg(F.min(pair)).scalar()

    best = {
        "top_sector": largest(by_sector(df), "sector"),
        "top_source": largest(by_source(df), "source"),
        "top_district": largest(by_district(df), "district"),
    }
    out = df.agg(F.count("*").alias("total")).withColumns(best)
    columns = [
        c
        for name in best
        for c in (F.col(f"{name}.v").alias(name), (-F.col(f"{name}.n")).alias(f"{name}_jobs"))
    ]
    return out.select(*columns, "total")


def table_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("total_jobs"), F.count_if("is_active").alias("active_jobs")
    )


def active_by_source(jobs: DataFrame) -> DataFrame:
    return value_counts(jobs.filter("is_active"), "source")


def recent_runs(runs: DataFrame, top: int = 10) -> DataFrame:
    return (
        runs.orderBy(F.desc("started_at"), F.asc("run_id"))
        .limit(top)
        .select("run_id", "source", "status", "jobs_new", "completed_at")
    )


def run_summary(postings: DataFrame, by: str = "source") -> DataFrame:
    """Per source: totals and how many records carry each fact."""
    return postings.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if("rwanda_eligible").alias("eligible"),
        F.count_if("salary_disclosed").alias("disclosed"),
        F.count_if("is_remote").alias("remote"),
        F.count_if(F.col("deadline") != "").alias("with_deadline"),
        F.count_if(F.col("education_level") != "").alias("with_education"),
        F.count_if(F.col("sector") == "Tender").alias("tenders"),
        F.count_if(F.col("sector") != "Tender").alias("jobs"),
    )


# fixed values: list lengths of the run summary
SUMMARY_TOP = {"sector": 5, "employment_type": 5, "job_level": 5, "company": 6}


def run_top_values(postings: DataFrame, by: str = "source") -> DataFrame:
    """Most frequent sectors, types, levels and companies per source, ranked.

    One pass: the four columns are unpivoted, counted with map-side combine, and
    only the counts are ranked.  Companies can be many, so ranking happens in two
    steps: within a hash bucket first, then among the bucket winners.
    """
    names = list(SUMMARY_TOP)
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names])
    counts = (
        postings.select(by, F.explode(pairs).alias("p"))
        .select(by, "p.dimension", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy(by, "dimension", "value")
        .agg(F.count("*").alias("count"))
    )
    size = F.coalesce(*[F.when(F.col("dimension") == n, F.lit(k)) for n, k in SUMMARY_TOP.items()])
    order = [F.desc("count"), F.asc("value")]
    bucket = F.pmod(F.xxhash64("value"), F.lit(64))
    local = counts.withColumn("_b", bucket).withColumn(
        "_r", F.row_number().over(Window.partitionBy(by, "dimension", "_b").orderBy(*order))
    )
    return (
        local.filter(F.col("_r") <= size)
        .withColumn("rank", F.row_number().over(Window.partitionBy(by, "dimension").orderBy(*order)))
        .filter(F.col("rank") <= size)
        .select(by, "dimension", "value", "count", "rank")
    )


def tender_split(postings: DataFrame) -> DataFrame:
    return postings.agg(
        F.count_if(F.col("sector") == "Tender").alias("tenders"),
        F.count_if(F.col("sector") != "Tender").alias("jobs"),
    )


def pipeline_totals(counts: DataFrame, removed: DataFrame, remaining: DataFrame) -> DataFrame:
    """Totals over all sources plus removed duplicates and final active postings."""
    totals = counts.agg(
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
        F.coalesce(F.sum("new"), F.lit(0)).alias("new"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
    )
    return totals.withColumns(
        {
            "removed": removed.agg(F.count("*")).scalar(),
            "final": remaining.agg(F.count("*")).scalar(),
        }
    )


def insights(df: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """All frames of the insights page over one scan."""
    return {
        "sectors": by_sector(df),
        "sources": with_share(by_source(df)),
        "districts": by_district(df),
        "timeline": per_day(df),
        "companies": by_company(df),
        "education": with_share(by_education(df)),
        "levels": by_level(df),
        "employment": with_share(by_employment_bucket(df)),
        "headline": headline(df, as_of),
        "cards": insight_cards(df),
        "summary": market_summary(df),
    }
