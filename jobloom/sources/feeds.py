"""Feeds and envelopes: RSS items, JSON with embedded HTML, tiers of one source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.dates import feed_day
from jobloom.functions.text import clean, company_from_slug, last_segment, nonempty, strip
from jobloom.operators.records import first_filled_tier

RSS_ITEM = "title string, link string, pubDate string"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Feed files, one row per item."""
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)


def stubs_from_items(items: DataFrame) -> DataFrame:
    """Feed items to stubs; items without link are dropped."""
    link = strip("link")
    return items.filter(nonempty(link).isNotNull()).select(
        F.coalesce(clean("title"), F.lit("")).alias("title"),
        link.alias("source_url"),
        last_segment(link).alias("source_job_id"),
        company_from_slug(link, "-kigali-rwanda-").alias("company"),
        feed_day(strip("pubDate")).alias("posted_date"),
        # fixed values: what the feed leaves out
        F.lit("Kigali (Rwanda)").alias("location_raw"),
        F.lit("Contract").alias("employment_raw"),
        F.lit("").alias("deadline"),
    )


def rss_stubs(df: DataFrame, column: str) -> DataFrame:
    """A column of ``<item>`` texts to stubs."""
    return stubs_from_items(df.select(F.from_xml(F.col(column), RSS_ITEM).alias("i")).select("i.*"))


def json_envelope(
    df: DataFrame, column: str, keep: Sequence[str] = (), found_type: str = "boolean"
) -> DataFrame:
    """``{found_jobs, html}`` payloads to pages; payloads that found nothing give no row."""
    parsed = F.from_json(F.col(column), f"found_jobs {found_type}, html string")
    return (
        df.select(*keep, parsed.alias("p"))
        .filter(F.col("p.found_jobs").cast("boolean"))
        .select(*keep, "p.found_jobs", F.coalesce("p.html", F.lit("")).alias("html"))
    )


def first_tier(df: DataFrame, partition: Sequence[str]) -> DataFrame:
    return first_filled_tier(df, partition)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines, Unicode unescaped."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (url, html)."""
    return spark.read.schema(T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])).parquet(path)
