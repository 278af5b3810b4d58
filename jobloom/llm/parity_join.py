"""Jaccard self-join of word shingles by parity sketches.

A set of shingles becomes a sketch in which every shingle flips what its hash selects.  Shingles
that two sets share cancel out, so sketches differ in at most as many places as the symmetric
difference has members.  Sets of a size band that are similar enough differ in at most d members;
cut into more than d blocks by shingle hash, some blocks of the two are then equal (pigeonhole).
A block's key is the exclusive or of the 64-bit hashes of its shingles: the digest of a parity
sketch of that block too wide to write down.  Sets that share a key are candidates; a narrow
sketch of parity bits, whose Hamming distance bounds the symmetric difference from below, drops
unlike pairs, and the shingles themselves decide.

Blocks with at most one shingle would make crowded keys of common passages.  A set has some more
blocks than d + 1, so it may leave out that many sparse ones without losing a partner.

The result is components, so no group is listed pair by pair: every key has a leader, and a set is
compared with the one leader that it shares most keys with.  Leaders are the smallest ids first;
then, where a key still holds several components, the sets with most company, then some picked
by hash.  Only sets that share a key and are then still apart are compared across components: the
few of a small key as pairs of ids, the many of a crowded one by their sketches inside the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import mixed, slices, stored, word_hashes
from jobloom.llm.components import components

#: Ratio of the sizes of a band: wide bands need more blocks, narrow ones put more sets in two bands.
BAND = 1.4
#: Bits per shingle of the sketches.
SKETCH = 2
#: A key with more sets than this that are still apart compares their sketches inside the join.
SMALL = 8
#: Tables of up to so many ids are sent to every task (16 bytes a row); larger ones are joined by an exchange.
SENT_IDS = 1 << 21

_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; of all words if there are fewer."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(min(width, len(hashes))))
        for i in range(min(width, len(hashes))):
            h = mixed(h * _K[0] + hashes[i : i + n] * _K[1])
    return np.unique(h)


def allowed(upper: int, percent: int) -> int:
    """Most members in the symmetric difference of similar sets whose larger one has ``upper``."""
    return (2 * upper * (100 - percent)) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, upper size) in which a set of ``n`` shingles meets its partners.

    Bands have fixed bounds.  A pair meets in the band of its larger set; a set that may be the
    smaller one of a pair in the next band takes part there, too.
    """
    band, upper = _band(n)
    found = [(band, upper)]
    while 100 * n >= percent * (upper + 1):
        band, upper = _band(upper + 1)
        found.append((band, upper))
    return found


def _band(n: int) -> tuple[int, int]:
    band = max(0, math.floor(math.log(n, BAND)) - 2)
    while math.floor(BAND ** (band + 1)) < n:
        band += 1
    return band, math.floor(BAND ** (band + 1))


def block_keys(sets: np.ndarray, percent: int, place: dict) -> np.ndarray:
    """Keys of the blocks of one set, for each band in which it takes part."""
    keys = []
    for band, upper in place.setdefault(len(sets), bands(len(sets), percent)):
        d = allowed(upper, percent)
        share = d / max(1, upper)
        spare = 0 if d < 4 else 1 + math.ceil((0.06 if share < 0.15 else 0.3) * d)
        n = d + 1 + spare
        block = ((sets >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        # sorted hashes lie in block order
        first = np.searchsorted(block, np.arange(n, dtype=np.uint64))
        count = np.diff(np.append(first, len(sets)))
        total = np.zeros(n, np.uint64)
        full = count > 0
        total[full] = np.bitwise_xor.reduceat(sets, first[full])
        with np.errstate(over="ignore"):
            key = mixed(total + mixed(np.arange(n, dtype=np.uint64) + np.uint64(band << 32)))
        # two similar sets agree in more than ``spare`` blocks, and an equal block is as sparse in both
        for most in (1, 0):
            if spare and (count <= most).sum() <= spare:
                key = key[count > most]
                break
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def parity_bits(sets: np.ndarray, factor: int) -> np.ndarray:
    """A sketch of parity bits, ``factor`` or more for each shingle of the band: every shingle flips one."""
    width = 1 << max(6, int(factor * _band(len(sets))[1]).bit_length())
    with np.errstate(over="ignore"):
        at = (mixed(sets * _K[1]) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1).view(np.int64)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) for runs of rows whose texts fit in memory together."""
    for start, rows in slices(batch):
        yield start, *word_hashes(rows.column("text").to_pylist())


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits of a set."""
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s).sum(dtype=np.uint64).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size and digest of every set."""
    for batch in batches:
        for start, hashes, bounds in _groups(batch):
            found = [_digest(shingles(hashes[a:b], width)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [pa.array([d[k] for d in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(found)), *columns], names=["doc_id", "n_shingles", "d1", "d2"])


def _keys(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keys of the first row of every set in this task."""
    seen: set[tuple] = set()
    place: dict[int, list] = {}
    for batch in batches:
        for start, hashes, bounds in _groups(batch):
            keys, ids = [], []
            for i, doc_id in enumerate(batch.column("doc_id").slice(start, len(bounds) - 1).to_pylist()):
                s = shingles(hashes[bounds[i] : bounds[i + 1]], width)
                if doc_id is None or not len(s) or (digest := _digest(s)) in seen:
                    continue
                seen.add(digest)
                keys.append(block_keys(s, percent, place))
                ids.append(np.full(len(keys[-1]), doc_id, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "doc_id"])


def _members(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, hashes, bounds in _groups(batch):
            sets = [shingles(hashes[a:b], width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array([parity_bits(s, SKETCH) if len(s) else None for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(sets)), *columns], names=["doc_id", "n", "members", "bits"])


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of ``docs`` (doc_id, text) under Jaccard similarity >= percent / 100.

    A set holds the distinct ``width``-word shingles of the whole text, A-Z lower-cased, words cut at
    ASCII white space; shorter texts are one shingle; null and empty texts have none and are linked
    with nothing.  Returns doc_id, n_shingles and component_id (smallest doc_id reachable) for
    every row.  A null doc_id is linked with nothing and has a null component.  Rows that repeat a
    doc_id share its component; if their texts differ, all of them link.  No rows give no rows;
    other columns are left out.  Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(lambda it: _sets(it, width), "doc_id long, n_shingles long, d1 long, d2 long"), "parity-sets")
    linkable = rows.where("doc_id is not null and n_shingles > 0")
    one = ["n_shingles", "d1", "d2"]
    classes = stored(linkable.groupBy(*one).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "parity-classes")

    # members of keys that two different sets share
    keyed = docs.mapInArrow(lambda it: _keys(it, width, percent), "key long, doc_id long")
    by_key = Window.partitionBy("key").orderBy("doc_id")
    lead = keyed.select("key", "doc_id", F.first("doc_id").over(by_key).alias("leader"), F.lead("doc_id").over(by_key).alias("after"))
    shared = lead.where((F.col("leader") != F.col("doc_id")) | (F.col("after") != F.col("doc_id"))).select("key", "doc_id")
    # a task keys the first row of a set that it meets; the set's smallest id stands for all of them
    repeated = stored(linkable.join(classes.where("copies > 1"), one).where("doc_id != first").select("doc_id", "first").distinct(), "parity-repeated-sets")
    # sent to every task, it leaves the rows dealt by key, so that distinct needs no exchange
    shared = shared.join(_sent(repeated), "doc_id", "left").select("key", F.coalesce("first", "doc_id").alias("doc_id")).distinct()
    shared = stored(shared, "parity-shared")
    crowd = shared.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high")
    shared = stored(shared.join(crowd, "key", "left_semi"), "parity-keys")

    ids = stored(shared.select("doc_id").distinct(), "parity-ids")
    members = _only(docs, ids).mapInArrow(lambda it: _members(it, width), "doc_id long, n long, members array<long>, bits array<long>")
    members = stored(members, "parity-members")

    # how much company a set has: the middle of a group has most
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    company = stored(shared.join(sizes, "key").groupBy("doc_id").agg(F.sum("size").alias("company")), "parity-company")
    shared = stored(shared.join(_sent(company), "doc_id"), "parity-accompanied")

    linked = asked = None
    for step in range(4):
        if linked is None:
            labelled = shared.withColumn("label", F.col("doc_id"))
        else:
            labelled = _labelled(shared, linked)
            # components only grow, so a key that lies within one is done with
            apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
            labelled = stored(labelled.join(apart, "key", "left_semi"), f"parity-apart-{step}")
            shared = labelled.drop("label")
        order = (F.struct("doc_id", "label"), F.struct(-F.col("company"), "doc_id", "label"), F.struct(F.xxhash64("doc_id"), "doc_id", "label"))[min(step, 2)]
        spread = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(order).alias("leader"), F.count(F.lit(1)).alias("sets")).where("low != high")
        if step < 3:
            # a member is compared with one leader: the one with which it shares most keys
            pairs = labelled.join(spread.select("key", "leader"), "key").where("label != leader.label")
            pairs = pairs.groupBy("doc_id", F.col("leader.doc_id").alias("leader")).agg(F.count(F.lit(1)).alias("keys"))
            pairs = pairs.select("doc_id", "leader", "keys", F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))
            if asked is not None:
                pairs = pairs.join(asked, ["a", "b"], "left_anti")
            pairs = pairs.groupBy("doc_id").agg(F.max(F.struct("keys", -F.col("leader"), "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        else:
            pairs = _apart(labelled.join(spread.select("key", "sets"), "key"), members, percent)
            if asked is not None:
                pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"parity-pairs-{step}")
        if not pairs.head(1):
            continue
        asked = pairs if asked is None else asked.unionByName(pairs)
        new = stored(_verified(pairs, members, percent, step), f"parity-links-{step}")
        # the components so far are stars already, which new links join
        links = new if linked is None else linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)
        linked = stored(components(links), f"parity-components-{step}")

    classes = classes.drop("copies")
    if linked is not None:
        classes = classes.join(linked.withColumnRenamed("node", "first"), "first", "left").withColumn("first", F.coalesce("component", "first")).drop("component")
    placed = linkable.join(classes, one).select("doc_id", "n_shingles", F.col("first").alias("component_id"))
    rest = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(rest)


def _labelled(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of keys with the component that they have so far."""
    own = shared.join(_sent(linked.withColumnRenamed("node", "doc_id")), "doc_id", "left")
    return own.withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, with all their columns.

    Rows without shingles or doc_id stay; of rows that repeat a kept doc_id one stays.
    """
    found = stored(similar(docs, width, percent), "parity-kept")
    losers = stored(found.where("doc_id != component_id").select("doc_id").distinct(), "parity-losers")
    repeated = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated, "parity-repeated")
    kept = docs.join(_sent(losers), "doc_id", "left_anti")
    if repeated.head(1):
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)


def _apart(keyed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a key; columns key, doc_id, label and sets of the key."""
    small = keyed.where(F.col("sets") <= SMALL)
    crowded = keyed.where(F.col("sets") > SMALL).join(members.select("doc_id", "n", "bits"), "doc_id")
    found = []
    for rows, columns in ((small, ["doc_id", "label"]), (crowded, ["doc_id", "label", "n", "bits"])):
        x, y = (rows.select("key", *(F.col(c).alias(c + side) for c in columns)) for side in "ab")
        may = _may_be_similar("a", "b", percent) if "n" in columns else F.lit(True)
        pairs = x.join(y, (x["key"] == y["key"]) & (F.col("labela") < F.col("labelb")) & may)
        found.append(pairs.select(F.least("doc_ida", "doc_idb").alias("a"), F.greatest("doc_ida", "doc_idb").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def _folded(x: str, y: str):
    """Sketch ``x`` in the width of ``y`` if that is half of its own: bits that would have met are added."""
    half = (F.size(x) / 2).cast("int")
    halves = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
    return F.when(F.size(x) == 2 * F.size(y), halves).otherwise(F.col(x))


def _may_be_similar(a: str, b: str, percent: int):
    """False only where sizes or sketches rule a pair out; columns n and bits end in ``a`` and ``b``.

    J >= p / 100 means |A xor B| * (100 + p) <= (100 - p) * (|A| + |B|).  A sketch of twice the
    width is folded to that of the other; sketches that differ more say nothing.
    """
    may = 100 * F.least("n" + a, "n" + b) >= percent * F.greatest("n" + a, "n" + b)
    x, y = _folded("bits" + a, "bits" + b), _folded("bits" + b, "bits" + a)
    differ = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    return may & ((F.size(x) != F.size(y)) | (differ * (100 + percent) <= (100 - percent) * (F.col("n" + a) + F.col("n" + b))))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of the ids, a written table: sent to every task while they are few, exchanged beyond."""
    return rows.join(_sent(ids), "doc_id", "left_semi")


def _sent(ids: DataFrame) -> DataFrame:
    """A written table with a few numbers for each id, to be sent to every task if it is small enough."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _verified(pairs: DataFrame, members: DataFrame, percent: int, step: int) -> DataFrame:
    """The pairs that are similar: sizes and sketches first, then the shingles of the sets that are left."""
    size = members.select("doc_id", "n", "bits")
    a, b = (size.select(F.col("doc_id").alias(s), *(F.col(c).alias(c + s) for c in ("n", "bits"))) for s in "ab")
    some = stored(pairs.join(a, "a").join(b, "b").where(_may_be_similar("a", "b", percent)).select("a", "b"), f"parity-likely-{step}")
    ids = stored(some.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"parity-likely-ids-{step}")
    needed = _only(members.select("doc_id", "members"), ids)
    a, b = (needed.select(F.col("doc_id").alias(s), F.col("members").alias("m" + s)) for s in "ab")
    both = F.size(F.array_intersect("ma", "mb"))
    full = some.join(a, "a").join(b, "b")
    return full.where(100 * both >= percent * (F.size("ma") + F.size("mb") - both)).select("a", "b")
