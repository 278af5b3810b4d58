"""License scan by sentence rules, with DataFrame functions only.

A text is cut into sentences, each normalised to lower-case words; sentences that a license is
known by get an identifier, and the sequence of identifiers is matched against ordered rules:
a rule applies where its identifiers follow each other.  Everything happens inside a row, so
nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import lower_ascii

# Normalised sentences of license notices.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it": "gpl-free",
    "this program is distributed in the hope that it will be useful": "gpl-hope",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-names",
    "all rights reserved": "all-rights",
}
# Ordered rules; the first rule of a license that applies names its form.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-compliance", "apache-copy")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-warranty")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-hope")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
)
SPLIT = "[.!?]+[\\x20\\x09-\\x0D]+|[\\x0A\\x0D]+"
NOISE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    sentences = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPLIT)
    known = F.create_map(*(F.lit(v) for pair in SENTENCES.items() for v in pair))
    named = F.transform(sentences, lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, NOISE, " "))))
    return F.filter(named, lambda i: i.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """Licenses of every row of ``docs`` (doc_id, text).

    Returns doc_id, sentence_ids (comma-joined, in order), licenses (distinct, sorted, comma-joined),
    n_licenses and unmatched (a license sentence without a rule that applies).  Null and empty
    texts have none; repeated rows get equal results; no rows give no rows; other columns are left
    out.
    """
    # delimiters on both sides make a run of identifiers a substring
    ids = docs.select("doc_id", sentence_ids(F.col("text")).alias("_ids"))
    line = F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))
    names = sorted({name for name, _ in RULES})
    applies = {name: [line.contains("," + ",".join(ids) + ",") for n, ids in RULES if n == name] for name in names}
    hits = F.array(*(F.when(_any(a), F.lit(name)) for name, a in applies.items()))
    found = ids.select("doc_id", F.array_join("_ids", ",").alias("sentence_ids"), F.filter(hits, lambda x: x.isNotNull()).alias("_found"), (F.size("_ids") > 0).alias("_some"))
    return found.select(
        "doc_id", "sentence_ids", F.array_join("_found", ",").alias("licenses"), F.size("_found").cast("long").alias("n_licenses"),
        (F.col("_some") & (F.size("_found") == 0)).alias("unmatched"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
