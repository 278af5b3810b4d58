"""Incremental ingest: the same step for a batch and for a stream of landing files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobloom.operators import ingest
from jobloom.schema import POSTING_SCHEMA, load_rows

_DATES = ("posted_date", "deadline")
STORED_SCHEMA = T.StructType(
    [T.StructField(f.name, T.DateType() if f.name in _DATES else f.dataType) for f in POSTING_SCHEMA]
)
RUN_SCHEMA = (
    "run_id bigint, source string, status string, started_at timestamp, completed_at timestamp, "
    "jobs_found bigint, jobs_new bigint, jobs_updated bigint, error_message string"
)


def ingest_batch(batch: DataFrame, store: str, runs: str, as_of: Column) -> DataFrame:
    """Append the unknown postings of a canonical batch and log one run per source.

    Idempotent by ``id``: running the same batch again adds nothing.  Returns the
    counters per source (found, new, updated, skipped).
    """
    spark = batch.sparkSession
    stored = ingest.read_or_empty(spark, store, STORED_SCHEMA)
    rows = load_rows(batch, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # counted before the append: the stored files were listed above and do not change here
        counts = ingest.ingest_counts(rows, stored)
        counted = spark.createDataFrame(counts.collect(), counts.schema)  # one row per source
        ingest.append_postings(ingest.new_rows(rows, stored), store)
        if counted.head(1):
            ingest.run_log(counted, as_of, F.current_timestamp()).write.mode("append").parquet(runs)
        return counted
    finally:
        rows.unpersist()


def stream_ingest(
    spark: SparkSession,
    landing: str,
    store: str,
    runs: str,
    checkpoint: str,
    as_of: Callable[[], Column] = F.current_timestamp,
    schema: T.StructType = POSTING_SCHEMA,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Ingest every landing file once, then stop; ``checkpoint`` must be a shared folder.

    ``prepare`` turns landing rows into canonical postings.  A replayed micro-batch is
    harmless because the step is idempotent.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def step(batch: DataFrame, _: int) -> None:
        ingest_batch(prepare(batch), store, runs, as_of())

    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
