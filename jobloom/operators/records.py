"""Stub/detail joins, first-of-key selection and unions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import first_nonempty, nonempty


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key by an explicit order; rows with an empty key go.

    ``min_by`` over the row struct aggregates map-side, so a hot key costs one
    partial row per task instead of one sorted group in a single task.
    """
    present = df
    for k in keys:
        present = present.filter((F.col(k).isNotNull()) & (F.col(k).cast("string") != ""))
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return (
        present.groupBy(*keys)
        .agg(first.alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
    )


def first_by_hash(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row per ``duplicate_hash``, the link standing in where the hash is empty."""
    keyed = df.withColumn("_key", first_nonempty("duplicate_hash", "source_url"))
    return first_per_key(keyed, ["_key"], order).drop("_key")


def attach_details(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Left join on ``source_url``; detail columns get the prefix ``d_``."""
    renamed = details.select(
        "source_url", *[F.col(c).alias(f"d_{c}") for c in details.columns if c != "source_url"]
    )
    return stubs.join(renamed, "source_url", "left")


def merge_fields(df: DataFrame, rules: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Per target column the first non-empty of its candidate columns, else the default."""
    return df.withColumns(
        {
            target: first_nonempty(*[c for c in candidates if c in df.columns], default=default)
            for target, (candidates, default) in rules.items()
        }
    )


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sources(builders: dict[str, Callable[[], DataFrame]], empty: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Union of all sources; one whose plan cannot be built adds no rows.

    Returns the union and the error text per failed source.
    """
    frames, errors = [empty], {}
    for name, build in builders.items():
        try:
            frames.append(build())
        except Exception as error:  # a broken source must not stop the others
            errors[name] = str(error)
    return union_all(frames), errors


def first_filled_tier(df: DataFrame, partition: Sequence[str], tier: str = "tier") -> DataFrame:
    """Keep the rows of the lowest tier present, per partition.

    The tier minimum is aggregated and joined back: no window sorts a whole source.
    """
    best = df.groupBy(*partition).agg(F.min(tier).alias("_best"))
    return df.join(best, list(partition)).filter(F.col(tier) == F.col("_best")).drop("_best")


def url_set(*frames: DataFrame, column: str = "source_url") -> DataFrame:
    """Distinct non-empty links of several frames."""
    return union_all(f.select(nonempty(column).alias(column)) for f in frames).filter(
        F.col(column).isNotNull()
    ).distinct()
