"""Compressed vector codes: every part of a vector becomes the index of a codebook entry.

Components are integers, so a batch of vectors holds few distinct values per dimension.  These
values form the dimension's dictionary; the squared differences of every distinct value to that
component of all entries are tabulated once per batch, and the distances of all parts to all
entries are gathers from those tables by dictionary code, added up over the part's dimensions.
Codebooks are bounded by entries and dimensions; only they and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import stored

#: Vectors whose distances are added up at a time, to bound memory.
BLOCK = 2048
#: Components above this would overflow the sums of squares.
LARGEST = 1 << 27


def integers(vectors: DataFrame, parts: int, scale: int, label: str | None) -> DataFrame:
    """vec_id, label and the vector in integers, for the rows that are kept."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fits = F.forall(x, lambda v: F.abs(v * scale) < LARGEST)
    units = F.when(fits, F.transform(x, lambda v: F.floor(v * scale).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is {LARGEST // scale} or more")).cast("array<int>"))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), units.alias("x"))


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column("x")
    rows = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)
    for start in range(0, len(rows), BLOCK):
        yield start, rows[start : start + BLOCK]


def nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for every part of every row; ties to the lower index.

    ``books`` is (parts, entries, dimensions of a part).
    """
    parts, entries, dims = books.shape
    index = np.empty((len(rows), parts), np.int64)
    least = np.empty((len(rows), parts), np.int64)
    for p in range(parts):
        total = np.zeros((len(rows), entries), np.int64)
        for d in range(dims):
            values, codes = np.unique(rows[:, p * dims + d], return_inverse=True)
            table = (values.astype(np.int64)[:, None] - books[p, :, d][None, :]) ** 2
            total += table[codes]
        index[:, p] = total.argmin(axis=1)
        least[:, p] = np.take_along_axis(total, index[:, p, None], axis=1)[:, 0]
    return index, least


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and component sums of what this task assigns to each entry."""
    parts, entries, dims = books.shape
    count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for batch in batches:
        for _, rows in _blocks(batch, parts * dims):
            index, _ = nearest(rows, books)
            for p in range(parts):
                count[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(total[p], index[:, p], rows[:, p * dims : (p + 1) * dims].astype(np.int64))
    part, entry = np.nonzero(count)
    if len(part):
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dims), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, dims = books.shape
    digits = 1 if books.shape[1] <= 256 else 2
    for batch in batches:
        code, error = [], []
        for _, rows in _blocks(batch, parts * dims):
            index, least = nearest(rows, books)
            code += [r.tobytes().hex() for r in index.astype(f">u{digits}")]
            error.append(least.sum(axis=1))
        columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(np.concatenate(error) if error else np.zeros(0, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, label: str | None = "label") -> tuple[DataFrame, np.ndarray | None]:
    """Codes of ``vectors`` (vec_id, embedding and a label) and their codebooks.

    Components become floor(scale * x).  The codebook of a part starts as that part of the vectors
    with the ``entries`` smallest vec_ids; every round assigns all parts to their nearest entry and
    moves each entry to the floor of the mean of its parts; unused entries stay.  Returns vec_id,
    code, error (squared distances over all parts) and label_error (error summed over equal labels).

    Left out are vectors that are null or empty, hold null or non-finite components, are of another
    length than the kept vector with the smallest vec_id, or of one that ``parts`` doesn't divide.
    Rows that repeat a vec_id are ordered by their vector; a null vec_id comes last.  Fewer vectors
    than ``entries`` make smaller codebooks; none give no rows and no codebooks.  Components of
    2 ** 27 / scale or more are an error.  Other columns are left out.
    """
    kept = stored(integers(vectors, parts, scale, label), "codes-vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    lead = kept.select(F.size("x").alias("s"), *("vec_id", "x")).orderBy(*order).limit(1).collect()
    if not lead:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    kept = kept.where(F.size("x") == lead[0]["s"])
    start = np.array([r["x"] for r in kept.select("vec_id", "x").orderBy(*order).limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    dims = books.shape[2]
    for _ in range(rounds):
        sums = kept.select("x").mapInArrow(lambda it, b=books: _sums(it, b), "part long, entry long, n long, sums array<long>")
        moved = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims)))
        new = books.copy()
        for r in moved.collect():  # parts * entries rows at most
            new[r["part"], r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
        books = new
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    coded = stored(kept.mapInArrow(lambda it: _codes(it, books), schema), "codes")
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error"), books


def digest(books: np.ndarray | None) -> str:
    """sha256 of all entries' components by part, entry and position, written in decimal."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()
