"""Byte-exact removal of repeated passages by run-length indexes (r-indexes).

Every string of ``length`` bytes picks an anchor, the smallest hash of its 32-grams, so equal
strings pick the same anchor at the same place, in whatever document they lie.  Consecutive
strings with one anchor form a context.  Anchors of one document hold no repeats across documents
and go after one aggregation; of the others, contexts that are equal are one class, in which only
the smallest document keeps its bytes.  What is left, contexts that share an anchor but differ,
meets by anchor in texts of bounded size.  Such a text gets a run-length index: its Burrows-
Wheeler transform, compressed to runs, with suffix samples and match lengths at the ends of runs
only.  Between samples lengths fall by one per byte and places move along, so matching statistics
stream from left to right; matches of ``length`` bytes or more link equal strings, and all of
these but the earliest are marked.  Repeats inside a document are found by its own index.

An anchor with more contexts than an index takes is split: its strings are halved by their
distance from the anchor, equal halves are one class again, and halves meet by what all strings in
them have in common, which is longer than the anchor.  Single strings are the last step, so every
group becomes small or is one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import mixed, slices, stored

#: Bytes of an anchor.
GRAM = 32
#: Bytes that are hashed at a time; longer texts overlap by one string.
CHUNK = 1 << 18
#: Contexts that an index takes; an anchor with more is split first.
LIMIT = 4096
#: A null doc_id comes after all others.
LAST = (1 << 63) - 1

_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Bits of a place in the key that a string's smallest gram is picked by.
_PLACE = np.uint64(20)


# ---- anchors and contexts


@dataclass
class Contexts:
    """Runs of strings with one anchor: the row, the first and last string, the anchor's place and hashes."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, np.uint64(base)))))


_UP, _DOWN = (_powers(b, 2 * CHUNK + 4096) for b in (_M, _INVERSE))


def _pieces(raws: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Buffers of about CHUNK bytes and the (row, start in the row, bytes) of which they consist."""
    held, parts, size = [], [], 0
    for i, raw in enumerate(raws):
        for start in range(0, len(raw) - length + 1, CHUNK):
            part = raw[start : start + CHUNK + length - 1]
            if size and size + len(part) > CHUNK + length:
                yield held, b"".join(parts)
                held, parts, size = [], [], 0
            held.append((i, start, len(part)))
            parts.append(part)
            size += len(part)
    if held:
        yield held, b"".join(parts)


def contexts(raws: list[bytes], length: int) -> Contexts:
    """All contexts of the texts, in order."""
    found = [_contexts(held, np.frombuffer(data, np.uint8), length) for held, data in _pieces(raws, length)]
    return Contexts(*(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 4 else np.uint64) for k in range(6)))


def _contexts(held: list[tuple[int, int, int]], data: np.ndarray, length: int) -> tuple:
    n, span = len(data), length - GRAM + 1
    row, start, size = np.array(held, np.int64).T
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _UP[:n])))
        gram = mixed((total[GRAM:] - total[:-GRAM]) * _DOWN[: n - GRAM + 1])
        low = (gram & ~((np.uint64(1) << _PLACE) - np.uint64(1))) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        strings = n - length + 1
        low = np.minimum(low[:strings], low[span - reach : span - reach + strings])
        place = (low & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        # strings that lie within one text
        own = np.repeat(np.arange(len(held)), size)[:strings]
        at = np.flatnonzero(np.arange(strings) + length <= (begin + size)[own])
        place, own = place[at], own[at]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (own[1:] != own[:-1]))))
        first, last, place, own = at[new], at[np.append(new[1:], len(at)) - 1], place[new], own[new]
        digest = (total[last + length] - total[first]) * _DOWN[first]
        digest = mixed(digest + mixed((last - first).astype(np.uint64) * np.uint64(4096) + (place - first).astype(np.uint64)))
    shift = (start - begin)[own]
    return row[own], first + shift, last + shift, place + shift, gram[place], digest


# ---- the index


@dataclass
class RunIndex:
    """Runs of the transform and, for the suffix on top of each run in text order, the suffix before it.

    ``symbols`` and ``lengths`` are the runs (256: a separator, which is a run of its own).  The
    suffix at ``at`` starts a run; ``to`` is the last of the run before, and they share ``shared`` bytes.
    """

    symbols: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    to: np.ndarray
    shared: np.ndarray

    def matches(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: how many bytes agree with the suffix before, and where that is."""
        k = np.searchsorted(self.at, places, "right") - 1
        moved = places - self.at[k]
        return self.shared[k] - moved, self.to[k] + moved


def build(texts: list[bytes]) -> RunIndex:
    """The index of texts, each followed by a separator of its own, separators in text order."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n = len(data)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size + 1) - 1
    left = np.repeat(ends, size + 1) - np.arange(n)
    padded = np.concatenate((data, np.zeros(7, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(8)) | np.where(left > j, padded[j : j + n], np.uint64(0))
    key = ((key << np.uint64(3)) | np.minimum(left, 7).astype(np.uint64)).view(np.int64)

    ranks, reach = [], 7
    ended = left < reach
    while True:
        # suffixes that have ended are ordered by place, which the first round settles
        order = np.argsort(key, kind="stable" if reach == 7 else None)
        sorted_key = key[order]
        new = np.concatenate(([False], (sorted_key[1:] != sorted_key[:-1]) | ended[order[1:]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append((reach, rank))
        if rank[order[-1]] == n - 1:
            break
        after = np.minimum(np.arange(n) + reach, n - 1)
        key = rank * (n + 1) + np.where(left >= reach, rank[after] + 1, 0)
        ended = np.zeros(n, bool)
        reach *= 2

    before = np.where(order > 0, data[order - 1].astype(np.int16), np.int16(256))
    before[(left[order - 1] == 0) | (order == 0)] = 256
    top = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 256))))
    at = order[top]
    to = np.where(top > 0, order[top - 1], at)
    shared = np.where(top > 0, _common(data, left, ranks, at, to), 0)
    by_place = np.argsort(at)
    return RunIndex(before[top], np.diff(np.append(top, n)), at[by_place], to[by_place], shared[by_place])


def _common(data: np.ndarray, left: np.ndarray, ranks: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and ``b`` share, up to a separator."""
    n = len(data)
    shared = np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()
    for reach, rank in reversed(ranks):
        same = (rank[a] == rank[b]) & (a != b)
        for x in (shared, a, b):
            x[same] += reach
        for x in (a, b):
            np.minimum(x, n - 1, out=x)
    going = np.ones(len(a), bool)
    for _ in range(7):
        going &= (left[a] > 0) & (left[b] > 0) & (data[a] == data[b])
        for x in (shared, a, b):
            x[going] += 1
    return shared


def earliest(texts: list[bytes], order: np.ndarray, step: int, length: int) -> list[np.ndarray]:
    """For every string of ``length`` bytes in every text, the smallest order of an equal one.

    The string at byte j of text i has the order ``order[i] + step * j``.
    """
    index = build(texts)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    strings = size - length + 1
    offset = np.concatenate(([0], np.cumsum(strings)))
    inside = np.arange(offset[-1]) - np.repeat(offset[:-1], strings)
    places = np.repeat(begin, strings) + inside
    shared, to = index.matches(places)
    root = np.arange(int(begin[-1] + size[-1] + 1))
    linked = shared >= length
    root[places[linked]] = to[linked]
    while True:
        jumped = root[root]
        if np.array_equal(jumped, root):
            break
        root = jumped
    own = np.repeat(np.asarray(order, np.int64), strings) + step * inside
    least = np.full(len(root), LAST)
    np.minimum.at(least, root[places], own)
    return np.split(least[root[places]], offset[1:-1])


def _runs(marked: np.ndarray) -> np.ndarray:
    """First and last of every run of true values, as rows."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return edges.reshape(-1, 2) - (0, 1)


# ---- tasks

_ROWS = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64())])
_MARKS = pa.schema([("doc", pa.int64()), ("digest", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
MARKS = "doc long, digest long, low int, high int"
PARTS = "key long, part long, digest long, doc long, low int, offset int, bytes binary"
_PARTS = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("offset", pa.int32()), ("bytes", pa.binary())])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) for rows that fit in memory together; a null text is empty."""
    for start, rows in slices(batch):
        texts = rows.column("text")
        yield start, [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]


def _rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        for start, raws in _texts(batch):
            c = contexts(raws, length)
            # one row for all places of a context in a document
            order = np.lexsort((c.digest, c.row))
            row, digest = c.row[order], c.digest[order]
            one = order[np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.anchor[one].view(np.int64), c.digest[one].view(np.int64), docs[start + c.row[one]])], schema=_ROWS)


def _wanted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The contexts that a document is asked for."""
    for batch in batches:
        docs, lists = batch.column("doc").to_pylist(), batch.column("digests")
        for start, raws in _texts(batch):
            c = contexts(raws, length)
            bounds = np.searchsorted(c.row, np.arange(len(raws) + 1))
            rows = []
            for i, raw in enumerate(raws):
                own = slice(bounds[i], bounds[i + 1])
                digests, at = np.unique(c.digest[own].view(np.int64), return_index=True)
                for k in bounds[i] + at[np.isin(digests, lists[start + i].values.to_numpy())]:
                    first, last, digest = int(c.first[k]), int(c.last[k]), int(c.digest[k].view(np.int64))
                    rows.append((int(c.anchor[k].view(np.int64)), digest, digest, docs[start + i], 0, first - int(c.place[k]) + length - GRAM, raw[first : last + length]))
            yield _batch(rows, _PARTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _halves(batches: Iterator[pa.RecordBatch], span: int, length: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut where their distance from the anchor is a multiple of ``span`` strings."""
    def number(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "big", signed=True)

    for batch in batches:
        rows = []
        for digest, doc, low, offset, raw in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc", "low", "offset", "bytes")), strict=True):
            end = offset + len(raw) - length
            for t in range(offset // span, end // span + 1):
                a, b = max(offset, t * span), min(end, t * span + span - 1)
                sub = raw[a - offset : b - offset + length]
                core = sub[t * span + span - 1 - a : t * span + length - a]
                place = (t * 256 + span).to_bytes(4, "big")
                rows.append((number(place, core), number(place, (a - t * span).to_bytes(4, "big"), sub), digest, doc, low + a - offset, a, sub))
        yield _batch(rows, _PARTS)


def _marked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strings that a smaller document of the same key has; rows come sorted by key."""
    held: list[tuple] = []

    def found(rows: list[tuple]) -> pa.RecordBatch:
        docs = np.array([r[2] for r in rows], np.int64)
        low = earliest([r[4] for r in rows], docs, 0, length)
        marks = [(r[2], r[1], r[3] + a, r[3] + b) for r, e in zip(rows, low, strict=True) for a, b in _runs(e < r[2]).tolist()]
        return _batch(marks, _MARKS)

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "doc", "low", "bytes")), strict=True):
            if len(held) >= LIMIT and held[-1][0] != r[0]:
                yield found(held)
                held = []
            held.append(r)
    if held:
        yield found(held)


def _own(raw: bytes, c: Contexts, own: slice, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last strings of the runs of a text's strings that start earlier in it, too."""
    digest, anchor, first, last = (x[own] for x in (c.digest, c.anchor, c.first, c.last))
    order = np.argsort(digest, kind="stable")
    again = np.concatenate((np.zeros(min(1, len(order)), bool), digest[order[1:]] == digest[order[:-1]]))
    once = np.sort(order[~again])
    low, high = [first[order[again]]], [last[order[again]]]
    _, group, count = np.unique(anchor[once], return_inverse=True, return_counts=True)
    some = once[count[group] > 1]
    some = some[np.argsort(anchor[some], kind="stable")]
    while len(some):
        # whole anchors, about as many contexts as an index takes
        stop = int(np.searchsorted(anchor[some], anchor[some[min(LIMIT, len(some)) - 1]], "right"))
        texts = [raw[first[k] : last[k] + length] for k in some[:stop]]
        least = earliest(texts, first[some[:stop]], 1, length)
        for k, e in zip(some[:stop], least, strict=True):
            runs = _runs(e < first[k] + np.arange(len(e)))
            low.append(first[k] + runs[:, 0])
            high.append(first[k] + runs[:, 1])
        some = some[stop:]
    return np.concatenate(low), np.concatenate(high)


def _asked(marks: pa.StructArray, c: Contexts, own: slice) -> tuple[np.ndarray, np.ndarray]:
    """First and last strings of the marks, at all places of their contexts in a text."""
    order = np.argsort(c.digest[own].view(np.int64), kind="stable")
    digests = c.digest[own].view(np.int64)[order]
    digest, low, high = (marks.field(f).to_numpy() for f in ("digest", "low", "high"))
    left = np.searchsorted(digests, digest)
    count = np.searchsorted(digests, digest, "right") - left
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    k = order[np.repeat(left, count) + inside]
    return c.first[own][k] + np.repeat(low, count), np.minimum(c.first[own][k] + np.repeat(high, count), c.last[own][k])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Removes what is marked from every text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for start, raws in _texts(batch):
            c = contexts(raws, length)
            bounds = np.searchsorted(c.row, np.arange(len(raws) + 1))
            removed, kept = [], []
            for i, raw in enumerate(raws):
                own = slice(bounds[i], bounds[i + 1])
                spans = [_own(raw, c, own, length)] if bounds[i] < bounds[i + 1] else []
                marks = batch.column("marks")[start + i]
                if marks.is_valid:
                    spans.append(_asked(marks.values, c, own))
                edge = np.zeros(len(raw) + 1, np.int64)
                for low, high in spans:
                    np.add.at(edge, low, 1)
                    np.subtract.at(edge, high + length, 1)
                runs = _runs(np.cumsum(edge[:-1]) > 0).tolist()
                removed.append([{"start": a, "end": b + 1} for a, b in runs])
                keep, at = [], 0
                for a, b in runs:
                    keep.append(raw[at:a])
                    at = b + 1
                kept.append(b"".join([*keep, raw[at:]]))
            columns = [batch.column("doc_id").slice(start, len(raws)), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "removed", "kept"])


# ---- the job


def _through_index(parts: DataFrame, length: int) -> DataFrame:
    """Marks of contexts (key, digest, doc, low, bytes) whose keys are small enough for one index."""
    dealt = parts.select("key", "digest", "doc", "low", "bytes").repartition("key").sortWithinPartitions("key", "doc", "digest", "low")
    return dealt.mapInArrow(lambda it: _marked(it, length), MARKS)


def marks(docs: DataFrame, length: int) -> DataFrame:
    """(doc, digest, low, high): strings low to high of the contexts with that digest lie in a smaller document, too.

    ``docs`` has doc and text.
    """
    rows = stored(docs.mapInArrow(lambda it: _rows(it, length), "anchor long, digest long, doc long"), "repeat-rows")
    by_anchor = rows.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("digest").alias("d1"), F.max("digest").alias("d2"))
    shared = stored(by_anchor.where("least < most").select("anchor", "least", (F.col("d1") != F.col("d2")).alias("unlike")), "repeat-anchors")
    rows = stored(rows.join(shared, "anchor"), "repeat-shared")

    whole = [F.lit(0).alias("low"), F.lit(1 << 20).alias("high")]
    alike = rows.where("not unlike and least < doc").select("doc", "digest", *whole)
    classes = stored(rows.where("unlike").groupBy("anchor", "digest").agg(F.min("doc").alias("least")), "repeat-classes")
    again = rows.where("unlike").drop("least").join(classes, ["anchor", "digest"]).where("least < doc").select("doc", "digest", *whole)
    found = [stored(alike.unionByName(again), "repeat-copies")]

    sizes = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIMIT).select("anchor"), "repeat-crowds")
    asked = classes.groupBy(F.col("least").alias("doc")).agg(F.collect_list("digest").alias("digests"))
    parts = docs.join(asked, "doc").mapInArrow(lambda it: _wanted(it, length), PARTS)
    parts = stored(parts, "repeat-contexts")
    crowds = sizes.withColumnRenamed("anchor", "key")
    found.append(stored(_through_index(parts.join(crowds, "key", "left_anti"), length), "repeat-marks"))

    crowd, span = parts.join(crowds, "key", "left_semi"), 1 << (length - GRAM).bit_length() - 1
    while span and sizes.head(1):
        halves = stored(crowd.mapInArrow(lambda it, s=span: _halves(it, s, length), PARTS), f"repeat-halves-{span}")
        classes = halves.groupBy("key", "part").agg(F.min("doc").alias("least"))
        halves = stored(halves.join(classes, ["key", "part"]), f"repeat-parts-{span}")
        strings = F.octet_length("bytes") - length
        found.append(halves.where("least < doc").select("doc", "digest", "low", (F.col("low") + strings).cast("int").alias("high")))
        sizes = halves.where("least = doc").select("key", "part").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = stored(sizes, f"repeat-sizes-{span}")
        halves = halves.where("least = doc").drop("least")
        found.append(stored(_through_index(halves.join(sizes.where(F.col("n") <= LIMIT).select("key"), "key", "left_semi"), length), f"repeat-marks-{span}"))
        sizes = sizes.where(F.col("n") > LIMIT).select("key")
        crowd, span = halves.join(sizes, "key", "left_semi"), span // 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Texts of ``docs`` (doc_id, text) without bytes covered by a repeated string of ``length`` bytes.

    A string is repeated if an equal one starts in a row with a smaller doc_id, or earlier in the
    same row; strings never cross rows, overlaps count, and all are judged on the input.  Returns
    doc_id, n_bytes, removed (maximal runs, as bytes start to end) and kept (the bytes that remain).

    A null text is empty.  A null doc_id comes after all others.  Rows that repeat a doc_id, and
    rows without one, are not compared with each other.  No rows give no rows; other columns are
    left out.  ``length`` is 64 to 224.  Contexts are compared by hashes of twice 64 bits, and
    byte by byte in an index.
    """
    if not 64 <= length <= 224:
        raise ValueError("length must be 64 to 224")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    by_doc = marks(docs.select("doc", "text"), length).groupBy("doc").agg(F.collect_list(F.struct("digest", "low", "high")).alias("marks"))
    rows = docs.join(by_doc, "doc", "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(lambda it: _cut(it, length), "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
