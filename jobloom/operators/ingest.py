"""Insert-if-absent, counters, run log, source statistics, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.records import first_per_key


def flag_new(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch with ``is_new``: the id is not stored yet.

    Left join against a distinct id column; AQE broadcasts the ids while they are
    small and otherwise shuffles ids only.
    """
    known = stored.select("id").distinct().withColumn("_known", F.lit(True))
    return batch.join(known, "id", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def new_rows(batch: DataFrame, stored: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows to insert: unknown ids, one row per id."""
    fresh = batch.join(stored.select("id"), "id", "left_anti").select(*batch.columns)
    return first_per_key(fresh, ["id"], order or [F.col("source_url")])


def ingest_counts(batch: DataFrame, stored: DataFrame, by: str = "source") -> DataFrame:
    """found / new / updated / skipped per source; nothing is ever updated."""
    return (
        flag_new(batch, stored)
        .groupBy(by)
        .agg(
            F.count("*").alias("found"),
            F.count_if("is_new").alias("new"),
            F.lit(0).cast("bigint").alias("updated"),
            F.count_if(~F.col("is_new")).alias("skipped"),
        )
    )


def run_log(counts: DataFrame, started_at: Column, completed_at: Column, error: Column | None = None) -> DataFrame:
    """One finished run per source that found something."""
    error = F.lit(None).cast("string") if error is None else error
    failed = error.isNotNull()
    return counts.filter("found > 0").select(
        F.xxhash64("source", started_at).alias("run_id"),
        "source",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        started_at.alias("started_at"),
        completed_at.alias("completed_at"),
        F.col("found").alias("jobs_found"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("new")).alias("jobs_new"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("updated")).alias("jobs_updated"),
        error.alias("error_message"),
    )


def update_source_stats(sources: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """``last_scraped`` and totals move for sources that ran; unknown names are ignored."""
    ran = counts.filter("found > 0").select(F.col("source").alias("name"), F.col("new").alias("_new"))
    return sources.join(ran, "name", "left").select(
        "name",
        F.when(F.col("_new").isNotNull(), as_of).otherwise(F.col("last_scraped")).alias("last_scraped"),
        (F.col("total_jobs_scraped") + F.coalesce("_new", F.lit(0))).alias("total_jobs_scraped"),
    )


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti").select(*table.columns)


def append_postings(rows: DataFrame, path: str) -> None:
    """Append to the table, partitioned by source so scans by source prune."""
    rows.write.mode("append").partitionBy("source").parquet(path)


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Write a new table version; the version being read is never overwritten."""
    target = f"{root.rstrip('/')}/v={version:08d}"
    table.write.mode("errorifexists").partitionBy("source").parquet(target)
    return target


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored table, or an empty one before the first load."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
