"""Consistent hashing with virtual nodes and bounded loads.

Every shard owns several points of a ring; a document goes to the first point clockwise of its
own hash.  Once a shard holds its share, its points are skipped, so what overflows continues
clockwise.  The capacities add up to the number of rows, so counts differ by one at most.

The ring has a fixed number of cells.  All documents of a cell see the same points, so the walk
needs only the count of every cell: a bounded table that is walked on the driver and comes back
as segments (cell, first rank, last rank, shard).  Documents are ranked inside their cell, and a
join with the segments places each.  One exchange, of ids and sizes only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the ring; the walk's input and the segments have about as many rows.
CELLS = 1 << 14
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cells and shards of the ring's points, clockwise; two points in one cell keep both."""
    points = sorted(
        (int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8], "big") % cells, shard)
        for shard in range(shards) for node in range(virtual_nodes)
    )
    return np.array([c for c, _ in points]), np.array([s for _, s in points])


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first, last, shard, slot of the first): ranks first..last of a cell go there.

    Cells arrive in hashed order, so that no region of the ring is served first.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    at, owner = ring(shards, virtual_nodes, cells)
    onward = list(range(len(at)))

    def open_point(p: int) -> int:
        path = []
        while True:
            if onward[p] != p:
                path.append(p)
                p = onward[p]
            elif filled[owner[p]] >= room[owner[p]]:
                path.append(p)
                p = onward[p] = (p + 1) % len(at)
            else:
                break
        for q in path:
            onward[q] = p
        return p

    segments = []
    for cell in sorted(counts, key=lambda c: hashlib.md5(str(c).encode()).digest()):
        done, left = 0, counts[cell]
        p = int(np.searchsorted(at, cell)) % len(at)
        while left:
            p = open_point(p)
            shard = int(owner[p])
            n = min(left, room[shard] - filled[shard])
            segments.append((cell, done + 1, done + n, shard, filled[shard]))
            filled[shard] += n
            done += n
            left -= n
    return segments


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard(docs: DataFrame, shards: int = 40, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Places every row of ``docs`` (doc_id, text) in a shard.

    Returns doc_id, size, text_crc32 (of the empty text for null), law (always "rows": counts
    differ by one at most), shard, slot (gapless from 0 in each shard) and grown_shard (null: the
    law depends on all rows).  A null doc_id hashes as a value of its own; repeated rows are
    rows of their own; no rows give no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(CELLS)).cast("int").alias("_cell"),
    )
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = pd.DataFrame(walk(counts, shards, virtual_nodes), columns=["_cell", "_first", "_last", "shard", "_slot"])
    segments = spark.createDataFrame(segments.astype("int64"), "_cell long, _first long, _last long, shard long, _slot long")
    order = Window.partitionBy("_cell").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    # at most one segment per cell and one more per shard
    placed = ranked.join(F.broadcast(segments), "_cell").where(F.col("_rank").between(F.col("_first"), F.col("_last")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
        (F.col("_slot") + F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
