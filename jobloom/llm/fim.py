"""Fill-in-middle: texts are cut in three and written with the middle last.

Hashes, cut points and forms are column expressions.  The cutting is a ``pyarrow.compute``
pipeline per batch: every text becomes a list of its units (code points), the lists are flattened
together with the index of their text, every unit gets its ordinal there and by that a role
(prefix, middle, suffix), the units of a role are filtered, put back into one list per text,
joined, and the three pieces are joined with their sentinels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units that are flattened at a time; longer texts are cut in segments of so many.
UNITS = 1 << 19


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """The code points of every text, as lists of one-character strings over the same bytes."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: bounds[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    starts = bounds[0] + np.flatnonzero((data[bounds[0] :] & 0xC0) != 0x80)
    ends = np.append(starts, bounds[-1]).astype(np.int32)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), texts.buffers()[2])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), units)


def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of every text: ``first`` units, up to ``second`` units, the rest."""
    lists = unit_lists(texts)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = lists.offsets.slice(0, len(lists)).cast(pa.int64())
    ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(begins, parents))
    early, late = pc.less(ordinals, pc.take(first, parents)), pc.greater_equal(ordinals, pc.take(second, parents))
    pieces = []
    for role in (early, pc.invert(pc.or_(early, late)), late):
        counts = np.bincount(pc.filter(parents, role).to_numpy(), minlength=len(lists))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        pieces.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, role)), ""))
    return pieces


def _segments(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """``cut`` for texts of any length: long ones in segments whose pieces are joined again."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes) or sizes.max() <= UNITS:
        return cut(texts, pa.array(first), pa.array(second))
    pieces = [[], [], []]
    for i, text in enumerate(texts.to_pylist()):
        parts = [[], [], []]
        for at in range(0, max(1, len(text)), UNITS):
            a, b = (pa.array([max(0, int(c[i]) - at)]) for c in (first, second))
            for out, piece in zip(parts, cut(pa.array([text[at : at + UNITS]]), a, b), strict=True):
                out.append(piece[0].as_py())
        for out, part in zip(pieces, parts, strict=True):
            out.append("".join(part))
    return [pa.array(p, pa.string()) for p in pieces]


def _written(form: pa.Array, texts: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    prefix, middle, suffix = _segments(texts, first, second)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "psm"), psm, spm))


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(batch.column("n").to_numpy())
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + UNITS, "right")))
            rows = batch.slice(start, stop - start)
            texts = rows.column("text").cast(pa.string())
            n, first, second = (pc.fill_null(rows.column(c), 0).to_numpy(zero_copy_only=False) for c in ("n", "prefix_chars", "middle_chars"))
            output = _written(rows.column("form"), texts, first, first + second)
            columns = [rows.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([*columns, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            start = stop


def _drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned integers of 32 bits for every id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, rate: int = 90, suffix_first: int = 20, seed: int = 1) -> DataFrame:
    """Fill-in-middle outputs of ``docs`` (doc_id, text), one row per row.

    Returns doc_id, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null
    for plain) and output.  ``rate`` per cent of the documents are transformed, ``suffix_first`` per
    cent of these as spm.  A null text counts as empty; empty texts and texts that hold a sentinel
    stay plain.  A null doc_id draws as an empty one; rows that repeat an id draw alike.  No rows
    give no rows; other columns are left out.  Memory is bounded by ``UNITS`` and the longest text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n"))
    h1, h2, h3, h4 = _drawn(F.col("doc_id"), seed)
    plain = (F.col("text") == "") | (h3 % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(sentinel))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select(
        "doc_id", "text", "n",
        F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(one, two).alias("low"), F.greatest(one, two).alias("high"),
    )
    shown = F.col("form") != "plain"
    rows = rows.select("doc_id", "text", "n", "form", F.when(shown, F.col("low")).alias("prefix_chars"), F.when(shown, F.col("high") - F.col("low")).alias("middle_chars"))
    return rows.mapInArrow(_outputs, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: its sentinels occur once each, so they part the pieces."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
