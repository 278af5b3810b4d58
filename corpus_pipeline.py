"""A corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import common, mixing, parity_join, sharding, toxicity, winnow

SHARDS = 40
_finished: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage starts when the one before has written its rows, so that one's helper tables go."""

    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete_stored(_finished)
        before = set(common.stored_folders())
        out = function(spark, docs, sf_dir)
        _finished[:] = [f for f in common.stored_folders() if f not in before]
        return out

    step.__name__, step.__doc__ = function.__name__, function.__doc__
    return step


@_stage
def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not call toxic."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


@_stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates: five-word shingles, similarity 0.8."""
    return parity_join.keep_one(docs, width=5, percent=80)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return winnow.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


@_stage
def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The stages learn and iterate, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
