"""Announcements that list several positions become one posting per position."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions.text import _col, identity, let, nonempty, strip


def announced_count(title: Column | str) -> Column:
    """``N positions / vacancies / jobs`` of a headline, 1 when no number is given."""
    n = F.regexp_extract(F.lower(_col(title)), r"(\d+)\s+(?:job\s+)?(?:positions?|vacancies|jobs)", 1)
    return F.coalesce(n.try_cast("int"), F.lit(1))


def is_multi_position(title: Column | str) -> Column:
    return (announced_count(title) > 1) | F.lower(_col(title)).rlike("multiple|several|various")


def _word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), 0))


def valid_title(c: Column | str) -> Column:
    """At least five characters, a job word, not a sentence, none of the skip words."""
    c = _col(c)
    low = F.lower(c)
    sentence = F.endswith(c, F.lit(".")) & (_word_count(c) > 15)
    return F.coalesce(
        (F.length(c) >= 5)
        & low.rlike("|".join(re.escape(w) for w in vocab.TITLE_JOB_WORDS))
        & ~sentence
        & ~low.rlike("|".join(re.escape(w) for w in vocab.TITLE_SKIP_WORDS)),
        F.lit(False),
    )


def _numbered(lines: Column) -> Column:
    found = F.transform(lines, lambda x: strip(F.regexp_extract(x, r"(?U)^\s*\d+[.)]\s*(.+?)$", 1)))
    return F.filter(found, valid_title)


def _bulleted(lines: Column) -> Column:
    # a lower-case o counts as a bullet sign, as in text copied from word processors
    found = F.transform(lines, lambda x: strip(F.regexp_extract(x, r"(?U)^\s*[*\-o]\s*(.+?)$", 1)))
    return F.filter(found, valid_title)


def _headlines(lines: Column) -> Column:
    """Lines ``Title at Company: (Deadline ...)``, each title once."""
    found = F.transform(
        F.filter(lines, lambda x: F.length(x) >= 10),
        lambda x: strip(F.regexp_extract(x, r"(?iU)^(.+?)\s+at\s+.+?:\s*\(deadline", 1)),
    )
    return F.array_distinct(
        F.filter(found, lambda t: valid_title(t) & F.length(t).between(6, 149))
    )


def _line_block(lines: Column, window: int = 50) -> Column:
    """Titles on lines of their own after a list announcement.

    A fold over at most ``window`` lines: blank or other lines end the block once
    two titles in a row were seen.
    """
    announced = F.transform(
        lines, lambda x: F.lower(x).rlike("|".join(re.escape(w) for w in vocab.LIST_INDICATORS))
    )
    start = F.coalesce(F.array_position(announced, F.lit(True)), F.lit(0)).cast("int")
    state = F.struct(
        F.array().cast("array<string>").alias("titles"), F.lit(0).alias("run"), F.lit(False).alias("done")
    )

    def step(s: Column, x: Column) -> Column:
        blank = x == ""
        good = valid_title(x) & (F.length(x) < 150)
        return F.when(s["done"], s).otherwise(
            F.struct(
                F.when(good, F.concat(s["titles"], F.array(x))).otherwise(s["titles"]).alias("titles"),
                F.when(good, s["run"] + 1).when(blank, s["run"]).otherwise(0).alias("run"),
                (~good & (s["run"] >= 2)).alias("done"),
            )
        )

    return F.aggregate(F.slice(lines, start + 1, window), state, step, lambda s: s["titles"])


def _comma_lists(lines: Column) -> Column:
    """Parts of lines that are mostly a comma-separated list of titles."""

    def parts(x: Column) -> Column:
        pieces = F.transform(F.split(x, ","), strip)

        def choose(p: Column) -> Column:
            good = F.filter(p, lambda t: valid_title(t) & (F.length(t) < 100))
            enough = (F.size(good) >= 3) & (F.size(good) / F.size(p) > 0.5)
            return F.when(enough, good).otherwise(F.array().cast("array<string>"))

        return let(pieces, choose)

    listed = F.filter(lines, lambda x: F.length(x).between(21, 499) & F.contains(x, F.lit(",")))
    return F.flatten(F.transform(listed, parts))


def listed_positions(description: Column | str) -> Column:
    """struct(method, titles) of the method that finds most; earlier methods win ties."""
    lines = F.transform(F.split(F.coalesce(_col(description), F.lit("")), "\n"), strip)

    def methods(x: Column) -> Column:
        headlines = _headlines(x)
        newline = F.when(F.size(headlines) > 0, headlines).otherwise(_line_block(x))
        found = [("numbered", _numbered(x)), ("bulleted", _bulleted(x)), ("newline", newline), ("comma", _comma_lists(x))]
        return F.array(
            *[
                F.struct(t.alias("titles"), F.lit(m).alias("method"), F.lit(-i).alias("order"))
                for i, (m, t) in enumerate(found)
            ]
        )

    ranked = F.transform(
        let(lines, methods),
        lambda m: F.struct(F.size(m["titles"]).alias("n"), m["order"].alias("o"), m["method"].alias("method"), m["titles"].alias("titles")),
    )
    return F.array_max(ranked)


def split_positions(postings: DataFrame) -> DataFrame:
    """One row per listed position; announcements that do not split stay whole."""
    best = F.when(is_multi_position("title"), listed_positions("description"))
    splits = F.col("_best.n") > 1
    whole = F.array(F.lit(None).cast("string"))
    key = F.col("_position")
    out = (
        postings.withColumn("_best", best)
        .withColumn("_position", F.explode(F.when(splits, F.col("_best.titles")).otherwise(whole)))
        .withColumn("extraction_method", F.when(key.isNotNull(), F.col("_best.method")))
        .withColumn("original_announcement", F.when(key.isNotNull(), F.col("title")))
    )
    return out.withColumns(
        {
            "id": F.when(key.isNotNull(), identity("source_url", F.lit("_"), key)).otherwise(F.col("id")),
            "duplicate_hash": F.when(
                key.isNotNull(), identity(key, F.lit("_"), F.coalesce("company", F.lit("")))
            ).otherwise(F.col("duplicate_hash")),
            "title": F.coalesce(nonempty(key), F.col("title")),
            "is_multi_position_split": key.isNotNull(),
        }
    ).drop("_best", "_position")
