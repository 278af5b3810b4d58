"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time: the words of its
source up to and including it, divided by the source's target.  All sources are read in the
order of finish times, over and over, until the total budget is used up; a source with twice the
target is then read twice as fast.  Only DataFrame functions are used.

Nothing of the corpus' size meets in one task: running sums are taken inside slices of
(source, hash prefix) and added to the sums of the slices before, and the end of the mix is
found by narrowing the range of finish times twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import stored

#: Slices of a source's shuffled order, as hexadecimal digits of the document's hash.
SLICE_DIGITS = 3
#: Slices of the finish times in each of the two narrowing steps.
STEPS = 4096
#: Up to so many documents' copies are sent to every task (12 bytes each); beyond, texts are exchanged once.
SENT_IDS = 1 << 21


def words(text: Column) -> Column:
    """Words without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, null last, take ``weights`` in turn and split ``share`` times
    all words.  A target stops at ``cap`` times its source's words; what is over goes to the
    others by weight.  That is one water level: sources in the order of their cap per weight
    are full while the level of the rest reaches them.  The frame has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = per_source.withColumn("_weight", at.cast("double")).withColumn("_cap", (F.lit(cap) * F.col("source_size")).cast("double"))
    order = [F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    levels = ranked.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_weight") >= F.col("_cap"))
    water = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source", "_level"))).over(every)["_level"]
    return levels.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(water * F.col("_weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, source, text).

    Returns doc_id, source, size, source_size, target, copies (whole readings of the document)
    and taken (copies times size).  Null sources form one source of their own, null texts have
    size 0, an empty frame gives an empty result; repeated rows count as documents of their own
    and stand next to each other in the order.  Other columns are left out.
    """
    rows = docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_order"),
    ).withColumn("_slice", F.substring("_order", 1, SLICE_DIGITS))
    rows = stored(rows, "mix-sizes")
    slices = stored(rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")), "mix-slices")
    goal = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("source", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    offsets = offsets.alias("a").join(goal.alias("b"), same).select("a.source", "_slice", "_offset", "source_size", "target")
    inside = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        rows.withColumn("_inside", F.sum("size").over(inside)).alias("a")
        .join(offsets.alias("b"), same & (F.col("a._slice") == F.col("b._slice")))
        .select("doc_id", "a.source", "size", "source_size", "target", (F.col("_inside") + F.col("_offset")).alias("_words"))
    )
    summed = stored(summed, "mix-order")

    readings = (
        summed.where("size > 0")
        .select("source", "size", "source_size", "target", "_words", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("_turn"))
        .select("source", "size", (F.col("_words") + F.col("_turn") * F.col("source_size")).alias("_at"), "target")
        .select("source", "size", "_at", (F.col("_at") / F.col("target")).alias("_finish"))
    )
    budget = goal.agg(F.sum("source_size")).first()[0] or 0
    last = _last_reading(readings, share * budget)
    if last is None:
        copies = F.lit(0)
    else:
        finish, nameless, source, at = last
        end = _key(F.lit(finish), F.lit(nameless), F.lit(source), F.lit(at).cast("long"))
        read = [F.col("_words") + turn * F.col("source_size") for turn in range(cap)]
        kept = [_key(at / F.col("target"), F.col("source").isNull(), F.coalesce(F.col("source"), F.lit("")), at) <= end for at in read]
        copies = sum((F.when(F.col("size") > 0, k.cast("long")).otherwise(0) for k in kept), F.lit(0))
    return summed.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows that repeat a doc_id are all taken as often as the one that is taken least.
    """
    taken = mix(docs, weights, share, cap).groupBy(F.col("doc_id").alias("_id")).agg(F.min("copies").cast("int").alias("_copies")).where("_copies > 0")
    taken = stored(taken, "mix-copies")
    rows = docs.join(F.broadcast(taken) if taken.count() <= SENT_IDS else taken, docs["doc_id"].eqNullSafe(taken["_id"]))
    return rows.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), taken["_copies"])).alias("_turn")).drop("_turn")


def _key(finish: Column, nameless: Column, source: Column, at: Column) -> Column:
    """The global order of readings."""
    return F.struct(finish.alias("a"), nameless.alias("b"), source.alias("c"), at.alias("d"))


def _last_reading(readings: DataFrame, budget: float):
    """The last reading in global order whose running sum stays within the budget.

    Finish times are mapped to [0, 1) by x / (1 + x), cut into steps, and the step in which the
    budget ends is cut again; only that small piece is sorted.
    """
    place = F.col("_finish") / (1 + F.col("_finish"))
    coarse = F.floor(place * STEPS).cast("long")
    fine = F.floor((place * STEPS - F.floor(place * STEPS)) * STEPS).cast("long")
    used, piece = 0, readings
    for step in (coarse, fine):
        sums = sorted((r["k"], r["s"]) for r in piece.groupBy(step.alias("k")).agg(F.sum("size").alias("s")).collect())
        for k, s in sums:
            chosen = k
            if used + s > budget:
                break
            used += s
        else:  # the budget holds everything in this piece
            used -= sums[-1][1] if sums else 0
        if not sums:
            return None
        piece = piece.where(step == chosen)
    order = _key(F.col("_finish"), F.col("source").isNull(), F.coalesce(F.col("source"), F.lit("")), F.col("_at"))
    piece = piece.select(order.alias("k"), "size")
    running = F.sum("size").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    found = piece.select("k", running.alias("s")).where(F.col("s") + used <= budget).agg(F.max("k").alias("k")).first()["k"]
    if found is None:  # the first reading of the piece is over the budget: the end is just before it
        start = piece.agg(F.min("k").alias("k")).first()["k"]
        return start["a"], start["b"], start["c"], start["d"] - 1
    return tuple(found)
