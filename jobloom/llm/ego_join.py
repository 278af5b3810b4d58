"""Near duplicates of embeddings by an epsilon grid order join.

Vectors are scaled to length one, so cosine >= t is distance <= epsilon = sqrt(2 - 2 t).  They are
turned to their principal axes and sorted by the cells (of side epsilon) of the leading axes.
The sequence is cut into blocks; a pair of blocks whose boxes are provably further apart than
epsilon is skipped, the rest are joined by halving the longer interval again and again, with the
same test on each half.  Leaves are compared by a matrix product in single precision with a safety
margin, and what is near the threshold or above is decided in double precision.

Equal vectors are one entry with a count.  A task never returns all links of a block: it returns
each vector's number of links, and enough links to join what is connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import stored
from jobloom.llm.components import components

#: Leading axes whose cells make the order, and axes whose boxes bound distances.
ORDER_AXES = 6
#: Vectors of a block (a unit of exchange) and of a leaf (a unit of comparison).
BLOCK = 4096
LEAF = 512
#: Single-precision products are off by less than this for unit vectors of a few thousand dimensions.
MARGIN = 1e-3


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<double> column of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and products of unit vectors of one task."""
    n, total, products = 0, None, None
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column("unit"))
        n, total, products = n + len(x), (0 if total is None else total) + x.sum(axis=0), (0 if products is None else products) + x.T @ x
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "total": pa.array([total.tolist()]), "products": pa.array([products.ravel().tolist()])})


def _axes(units: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes, leading first.  One row per task comes to the driver."""
    rows = units.select("unit").mapInArrow(_moments, "n long, total array<double>, products array<double>").collect()
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["total"]) for r in rows) / n
    square = sum(np.array(r["products"]) for r in rows).reshape(len(mean), -1) / n
    _, axes = np.linalg.eigh(square - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def _turned(batches: Iterator[pa.RecordBatch], mean: np.ndarray, axes: np.ndarray, side: float) -> Iterator[pa.RecordBatch]:
    """Coordinates on the principal axes and the cells of the leading ones."""
    for batch in batches:
        x = _matrix(batch.column("unit"))
        y = x @ axes
        cells = np.floor((y - mean @ axes)[:, :ORDER_AXES] / side).astype(np.int32)
        lists = [pa.array(list(v), pa.list_(kind)) for v, kind in ((y.astype(np.float64), pa.float64()), (cells, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), *lists], names=["vec_id", "copies", "turned", "cells"])


def _boxes_apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > eps * eps + MARGIN


def _intervals(x: np.ndarray, y: np.ndarray, eps: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of leaves (from, to, from, to) that are not provably apart."""
    boxes: dict[tuple[int, int, int], tuple] = {}

    def box(side: int, lo: int, hi: int) -> tuple:
        key = (side, lo, hi)
        if key not in boxes:
            v = (x, y)[side][lo:hi]
            boxes[key] = (v.min(axis=0), v.max(axis=0))
        return boxes[key]

    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        if _boxes_apart(box(0, a, b), box(1 - same, c, d), eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield a, b, c, d
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _connected(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The forest after linking u with v; every node points at the smallest of its tree."""
    while len(u):
        parent = _roots(parent)
        a, b = parent[u], parent[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return _roots(parent)


def join_blocks(ids_x, x, n_x, ids_y, y, n_y, t: float, same: bool):
    """Links between two blocks of unit vectors, or inside one.

    Returns ids with their numbers of links, and pairs of ids that connect what the links do.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * t))
    degree = [np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)]
    parent = np.arange(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    for a, b, c, d in _intervals(x, y, eps, same):
        i, j = np.nonzero(fx[a:b] @ fy[c:d].T >= t - MARGIN)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[u], y[v]) >= t
            u, v = u[ok], v[ok]
            np.add.at(degree[0], u, n_y[v])
            np.add.at(degree[1], v, n_x[u])
            parent = _connected(parent, u, v + shift)
    ids = ids_x if same else np.concatenate([ids_x, ids_y])
    pairs = [(ids[k], ids[parent[k]]) for k in np.flatnonzero(parent != np.arange(len(parent)))]
    if same:
        return [(ids_x, degree[0] + degree[1])], pairs
    return [(ids_x, degree[0]), (ids_y, degree[1])], pairs


def _join(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair of blocks; a pair is compared when its last row has come."""
    waiting: list[pa.RecordBatch] = []
    key = None

    def compare():
        rows = pa.Table.from_batches(waiting)
        left = rows.filter(pa.compute.equal(rows["block"], key[0])) if key[0] != key[1] else rows
        right = rows.filter(pa.compute.equal(rows["block"], key[1])) if key[0] != key[1] else rows
        if not len(left) or not len(right):
            return
        sides = [(r["vec_id"].to_numpy(), np.stack([np.asarray(v) for v in r["turned"].to_numpy()]), r["copies"].to_numpy()) for r in (left, right)]
        counts, pairs = join_blocks(*sides[0], *sides[1], t, key[0] == key[1])
        for ids, n in counts:
            some = n > 0
            yield _links(ids[some], ids[some], n[some])
        if pairs:
            a, b = np.array(pairs, dtype=np.int64).T
            yield _links(a, b, np.zeros(len(a), np.int64))

    for batch in batches:
        p, q = batch.column("p").to_numpy(), batch.column("q").to_numpy()
        cuts = np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if hi > lo and key != (now := (int(p[lo]), int(q[lo]))):
                if waiting:
                    yield from compare()
                waiting, key = [], now
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield from compare()


def _links(a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Links of ``vectors`` (vec_id, embedding) with cosine >= threshold, in double precision.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable,
    itself included) and kept.  Vectors that are null, empty, zero, or hold null or non-finite
    components have no links; so have rows without a vec_id, whose component is null.  Vectors
    of different lengths are not compared.  Rows that repeat a vec_id are copies like any others
    and share its component.  No rows give no rows; other columns are left out.
    """
    value = F.col("embedding").cast("array<double>")
    square = F.aggregate(value, F.lit(0.0), lambda s, v: s + v * v)
    # scaling by the largest component first keeps squares finite
    largest = F.array_max(F.transform(value, lambda v: F.abs(v)))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size(value) > 0) & ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (largest > 0), F.lit(False))
    scaled = F.transform(value, lambda v: v / largest)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, scaled).alias("v"))
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, v: s + v * v))
    units = rows.where(F.col("v").isNotNull()).withColumn("norm", norm).select("vec_id", F.transform("v", lambda v: v / F.col("norm")).alias("unit"))
    # equal vectors become one entry before anything is compared
    named = stored(units.withColumn("key", F.sha2(F.to_binary(F.to_json("unit"), F.lit("utf-8")), 256)), "ego-units")
    entries = stored(named.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "ego-entries")
    links = None
    for size in [r["s"] for r in entries.select(F.size("unit").alias("s")).distinct().collect()]:
        found = _links_of(entries.where(F.size("unit") == size), threshold)
        links = found if links is None else links.unionByName(found)
    everyone = rows.select("vec_id")
    if links is None:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = stored(links, "ego-links")
    far = links.where("a = b").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("far"))
    parts = components(links.where("a != b").select("a", "b"))
    classes = entries.select("key", F.col("vec_id").alias("first"), "copies").join(far, "first", "left")
    classes = classes.join(parts.withColumnRenamed("node", "first"), "first", "left").select(
        "key", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    found = named.select("vec_id", "key").join(classes, "key").select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of(entries: DataFrame, t: float) -> DataFrame:
    """(a, a, n) for entries with n links to other entries, and (a, b, 0) that connect them."""
    spark = entries.sparkSession
    mean, axes = _axes(entries)
    side = math.sqrt(max(0.0, 2 - 2 * t)) or 1.0
    turned = entries.select("vec_id", "copies", "unit").mapInArrow(
        lambda it: _turned(it, mean, axes, side), "vec_id long, copies long, turned array<double>, cells array<int>"
    )
    turned = stored(turned, "ego-turned")
    # the grid order, cut into blocks: cells are counted, long runs of one cell are cut by hash
    per_cell = turned.groupBy("cells").agg(F.count(F.lit(1)).alias("n"))
    # running sums inside ranges of cells, and over the ranges, of which there are as many as partitions
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_cell = stored(per_cell.repartitionByRange(ranges, "cells").withColumn("range", F.spark_partition_id()), "ego-cells")
    inside = Window.partitionBy("range").orderBy("cells").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.groupBy("range").agg(F.sum("n").alias("_sum")).select("range", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    starts = per_cell.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, "range").select("cells", "n", (F.col("_inside") + F.col("_offset")).alias("start"))
    placed = turned.join(starts, "cells")
    within = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) * F.col("n") / (1 << 20))
    placed = stored(placed.select("vec_id", "copies", "turned", "cells", F.floor((F.col("start") + within) / BLOCK).cast("int").alias("block")), "ego-blocks")
    boxes = placed.select("block", F.posexplode("turned").alias("axis", "v")).where(F.col("axis") < 16)
    boxes = boxes.groupBy("block", "axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).groupBy("block")
    boxes = stored(boxes.agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("box")), "ego-boxes")
    # boxes that are near meet in a cell of the two leading axes; the first of their common cells names the pair
    reach = math.sqrt(side * side + MARGIN)

    def cells_of(name: str, by: float) -> list[Column]:
        axes_ = [F.get(F.col("box"), axis) for axis in (0, 1)]
        ends = [(F.coalesce(a["lo"], F.lit(0.0)) - by, F.coalesce(a["hi"], F.lit(0.0)) + by) for a in axes_]
        return [F.floor(v / side).cast("int").alias(f"{name}{axis}{end}") for axis, pair in enumerate(ends) for end, v in zip("lh", pair, strict=True)]

    sides = []
    for name, box, by in (("p", "x", 0.0), ("q", "y", reach)):
        some = boxes.select(F.col("block").alias(name), F.col("box").alias(box), *cells_of(name, by))
        some = some.withColumn("c0", F.explode(F.sequence(f"{name}0l", f"{name}0h"))).withColumn("c1", F.explode(F.sequence(f"{name}1l", f"{name}1h")))
        sides.append(some)
    gap = F.zip_with("x", "y", lambda u, v: F.greatest(F.lit(0.0), u["lo"] - v["hi"], v["lo"] - u["hi"]))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= side * side + MARGIN
    first = (F.col("c0") == F.greatest("p0l", "q0l")) & (F.col("c1") == F.greatest("p1l", "q1l"))
    # blocks, not vectors, and each pair with two boxes
    pairs = sides[0].join(sides[1], ["c0", "c1"]).where((F.col("p") <= F.col("q")) & first & near).select("p", "q")
    pairs = stored(pairs, "ego-pairs")
    wanted = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    n = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = wanted.join(placed, "block").repartition(n, "p", "q").sortWithinPartitions("p", "q", "block", "cells", "vec_id")
    return work.select("p", "q", "block", "vec_id", "copies", "turned").mapInArrow(lambda it: _join(it, t), "a long, b long, n long")
