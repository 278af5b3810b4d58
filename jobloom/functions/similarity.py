"""Sequence similarity and the exact filters that keep it off most pairs."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.text import let

# Letters and digits dealt into buckets; strings whose bucket counts differ by more than
# the slack cannot qualify.  Any partition would give the same result.
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
BUCKETS = 9


def letter_counts(text: Column) -> Column:
    """Number of characters of the text per bucket."""
    size = F.length(text)
    return F.array(
        *[size - F.length(F.translate(text, _ALPHABET[i::BUCKETS], "")) for i in range(BUCKETS)]
    )


def both_above(first: Column, second: Column, value: float) -> Column:
    """1 where the ratio of (first, second) is above ``value``, plus 2 where that of (second, first) is.

    Matching blocks are a common subsequence, so pairs whose longest one is too short are
    left out before any blocks are looked for.
    """

    @F.pandas_udf(T.ByteType())
    def above(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            a, b = a.to_numpy(), b.to_numpy()
            total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
            out = np.zeros(len(a), np.int8)
            for i in np.flatnonzero(2.0 * common_lengths(a, b) > value * total - 1e-6):
                ab, ba = (SequenceMatcher(None, x, y).ratio() > value for x, y in ((a[i], b[i]), (b[i], a[i])))
                out[i] = ab + 2 * ba
            yield pd.Series(out)

    return above(first, second)


def common_lengths(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of strings of up to 64 characters; of others, a bound.

    One bit per character of ``first``; a whole row of the table of lengths is one addition.
    """
    sizes = np.array([[len(a), len(b)] for a, b in zip(first, second, strict=True)], np.int64).reshape(-1, 2)
    found = sizes.min(axis=1)
    short = np.flatnonzero(sizes.max(axis=1) <= 64)
    for at in range(0, len(short), 4096):
        rows = short[at : at + 4096]
        a, b = _points(first[rows], sizes[rows, 0], 0), _points(second[rows], sizes[rows, 1], 0xFFFFFFFF)
        row = np.full(len(rows), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in range(sizes[rows, 1].max()):
            same = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view("<u8")[:, 0]
            hit = row & same
            row = (row + hit) | (row - hit)
        found[rows] = np.bitwise_count(~row)
    return found


def _points(texts: np.ndarray, sizes: np.ndarray, blank: int) -> np.ndarray:
    """Characters plus one as a row of 64 numbers per text, ``blank`` after its end."""
    out = np.full((len(texts), 64), blank, np.uint32)
    out[np.arange(64) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) + 1
    return out


class Threshold:
    """``ratio > 1 - num/den`` with the integer bounds that follow from it.

    A ratio above the threshold leaves fewer than ``num/den`` of all characters
    unmatched.  Each unmatched character destroys at most ``q`` q-grams of its own
    string and, standing between matched ones, ``q - 1`` of the other, which bounds
    from below how many q-grams qualifying strings share.
    """

    def __init__(self, num: int, den: int, q: int):
        self.num, self.den, self.q = num, den, q

    @property
    def value(self) -> float:
        return (self.den - self.num) / self.den

    def slack(self, total: Column) -> Column:
        """Most characters of both strings together that may stay unmatched."""
        return F.floor((F.lit(self.num) * total - 1) / F.lit(self.den)).cast("int")

    def plausible(self, a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
        """Necessary tests inside the JVM, cheapest first, each within the slack.

        Length difference, difference of the letter counts, edit distance.
        """
        slack = self.slack(F.length(a) + F.length(b))
        apart = F.abs(counts_a[0] - counts_b[0])
        for i in range(1, BUCKETS):
            apart = apart + F.abs(counts_a[i] - counts_b[i])
        near = (F.abs(F.length(a) - F.length(b)) <= slack) & (apart <= slack)
        return near & (F.call_function("levenshtein", a, b, slack) >= 0)

    def unmatched(self, length: int, other: int) -> tuple[int, int] | None:
        """Most characters that stay unmatched in strings of these lengths; null if none qualify."""
        d = (self.num * (length + other) - 1) // self.den
        d -= (d - length - other) % 2  # unmatched characters have the parity of the total
        return ((d + length - other) // 2, (d + other - length) // 2) if d >= abs(length - other) else None

    def shared_by(self, length: int, other: int) -> int:
        """Least number of common q-grams, repeats counted, of qualifying strings of these lengths."""
        mine, others = self.unmatched(length, other)
        return length - self.q + 1 - self.q * mine - (self.q - 1) * others

    def fewest_shared(self, length: int) -> int:
        """Least number of common q-grams over every partner length the ratio allows."""
        top = length * (self.den + self.num) // (self.den - self.num) + 1
        others = (o for o in range(1, top + 1) if self.unmatched(length, o))
        return max(min((self.shared_by(length, o) for o in others), default=length), 1)

    def shared_grams(self, length: Column) -> Column:
        """:meth:`fewest_shared` from a constant table; longer strings use its last entry."""
        table = F.split(F.lit(" ".join(str(self.fewest_shared(n)) for n in range(1, 201))), " ")
        return F.element_at(table, F.least(length, F.lit(200))).cast("int")

    def grams(self, text: Column) -> Column:
        """Distinct q-grams in text order of the grams; empty for text shorter than ``q``."""
        size = F.length(text) - (self.q - 1)
        cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(text, i, F.lit(self.q)))
        return F.when(size >= 1, F.sort_array(F.array_distinct(cut))).otherwise(
            F.array().cast("array<string>")
        )

    def frequent_grams(self, df: DataFrame, text: str, top: int = 512) -> list[str]:
        """At most ``top`` grams of the column, the most frequent last."""
        counts = df.select(F.explode(self.grams(F.col(text))).alias("g")).groupBy("g").count()
        rows = counts.orderBy(F.desc("count"), F.asc("g")).limit(top).collect()
        return [r.g for r in reversed(rows)]

    def with_keys(
        self, df: DataFrame, text: str, level: Column, frequent: list[str], into: str = "_key"
    ) -> DataFrame:
        """One row per join key of ``text``, with its letter counts in ``_counts``.

        If two sets share ``s`` elements, their ``|set| - s + k`` smallest elements
        under one common order share ``k`` of them, so rows meet on combinations of
        ``k`` grams.  ``level`` is the k of the row's block: crowded blocks ask for
        more grams at once, which keeps every key selective without losing a pair.
        Level 0 is one key for the whole block.
        A text that need not share that many grams also meets on smaller k.  The
        common order puts ``frequent`` grams last; it affects speed, not the result.
        """
        length = F.length(text)
        late = F.split(F.lit("\x02".join(frequent)), "\x02")

        def keys(x: Column) -> Column:
            grams, level = x["grams"], x["level"]
            # repeated grams of the text may all fall on one distinct gram
            repeats = length - (self.q - 1) - F.size(grams)
            shared = F.greatest(self.shared_grams(length) - repeats, F.lit(1))

            def of_level(k: int) -> Column:
                emits = (level == k) | ((level > k) & (shared <= k))
                prefix = F.slice(grams, 1, F.greatest(F.size(grams) - shared + k, F.lit(0)))
                combined = let(prefix, lambda items: _combinations(items, k))
                return F.when(emits, combined).otherwise(F.array().cast("array<string>"))

            return F.concat(*[of_level(k) for k in range(1, LEVELS + 1)])

        ordered = let(
            self.grams(F.col(text)),
            lambda g: F.concat(F.array_except(g, late), F.array_intersect(late, g)),
        )
        staged = F.struct(ordered.alias("grams"), level.alias("level"))
        # level 0: so few members that all of them meet, and no gram is cut
        found = F.when(level == 0, F.array(F.lit(""))).otherwise(let(staged, keys))
        return df.withColumns({"_counts": letter_counts(F.col(text)), into: F.explode(found)})


LEVELS = 4


def _combinations(items: Column, k: int) -> Column:
    """All k-element combinations of an array of strings, each as one string."""
    if k == 1:
        return items

    def starting_with(x: Column, i: Column) -> Column:
        following = F.slice(items, i + 2, F.size(items))
        return F.transform(_combinations(following, k - 1), lambda y: F.concat(x, F.lit("\x01"), y))

    return F.flatten(F.transform(items, starting_with))


# Subsequences of one string, at most, that stand for it when it is compared with one length.
SUBSEQUENCES = 256
# Grams whose frequency is known when keys are cut, at most.
KNOWN_GRAMS = 1 << 16


class LengthPlan:
    """How distinct strings meet, for every two lengths that occur and may qualify.

    Where few characters may stay unmatched, strings meet on what is left of them without
    these: qualifying strings have a common subsequence of that length, and hardly others do.
    Otherwise they meet on combinations of q-grams as in :meth:`Threshold.with_keys`, with
    the bound of just these lengths and the grams in the order of their chance to meet.
    """

    def __init__(self, threshold: Threshold, sizes: dict[int, int], level_of: Callable[[int], int]):
        self.q = threshold.q
        self.cuts: dict[int, list[tuple[int, int, int]]] = {}  # length -> (tag, side, characters left out)
        self.grams: dict[int, list[tuple[int, int, int, int, int]]] = {}  # -> (tag, side, other, shared, level)
        tag = 0
        for a in sorted(sizes):
            for b in sorted(sizes):
                drops = threshold.unmatched(a, b) if a <= b else None
                if drops is None or (a == b and drops[0] == 0):
                    continue
                tag += 1
                few = comb(a, drops[0]) <= SUBSEQUENCES and comb(b, drops[1]) <= SUBSEQUENCES
                level = level_of(sizes[a] + (sizes[b] if a != b else 0))
                for side, (mine, other, drop) in enumerate([(a, b, drops[0]), (b, a, drops[1])][: 1 if a == b else 2]):
                    if few:
                        self.cuts.setdefault(mine, []).append((tag, side, drop))
                    else:
                        self.grams.setdefault(mine, []).append((tag, side, other, threshold.shared_by(mine, other), level))

    def ask_for_more(self, sizes: dict[int, int], known: dict[tuple[int, str], int], most: int = 16) -> None:
        """Combine more grams where a string then still has about ``most`` keys, so that fewer strings meet.

        What a string shows and the other length never does leaves few grams to combine.
        """
        never: dict[tuple[int, int], float] = {}
        sides: dict[int, list[tuple[int, int, int, int]]] = {}
        for own, entries in self.grams.items():
            for tag, _, other, shared, level in entries:
                alone = sum(n for (size, g), n in known.items() if size == own and (other, g) not in known) if (own, other) not in never else 0
                never.setdefault((own, other), alone / sizes[own])
                sides.setdefault(tag, []).append((own, other, shared, level))
        levels = {}
        for tag, both in sides.items():
            levels[tag] = both[0][3]
            for k in range(max(1, both[0][3]) + 1, MOST_GRAMS + 1):
                left = [round(own - self.q + 1 - max(1, shared) + k - never[own, other]) for own, other, shared, _ in both]
                if not both[0][3] or any(comb(max(n, 0), k) > most for n in left) or any(shared < k for _, _, shared, _ in both):
                    break
                levels[tag] = k
        self.grams = {own: [(*e[:4], levels[e[0]]) for e in entries] for own, entries in self.grams.items()}

    def gram_counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(length, gram, count) of the lengths that meet on grams, per batch."""
        for batch in batches:
            found = Counter(
                (len(t), g) for t in batch.column(1).to_pylist() if len(t) in self.grams for g in self._distinct(t)
            )
            columns = [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["size", "gram", "n"])

    def _distinct(self, text: str) -> set[str]:
        return {text[i : i + self.q] for i in range(len(text) - self.q + 1)}

    def sketches(self, batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
        """(bucket, keys): what is left of the keys of subsequences, four bytes each and no owner."""
        kept, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                kept += [key for key, _, _ in self._cut_keys(part.column(0).to_numpy(), part.column(1).to_pylist())]
                size = sum(map(len, kept))
                if size >= SKETCHED:
                    yield from _bucketed(kept, buckets)
                    kept, size = [], 0
        if size:
            yield from _bucketed(kept, buckets)

    def keys(
        self, batches: Iterator[pa.RecordBatch], known: dict[tuple[int, str], int], whole: bool, marks: np.ndarray | None = None
    ) -> Iterator[pa.RecordBatch]:
        """(key, side, id) of (id, text) rows.  ``whole``: grams not in ``known`` do not occur.

        With ``marks`` (buckets, bytes) keys of subsequences that nobody else has are left out.
        """
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                cut = self._cut_keys(ids, texts)
                if marks is not None:
                    cut = (tuple(c[shared] for c in k) for k in cut if (shared := _marked(k[0], marks)).any())
                out = [*cut, *self._gram_keys(ids, texts, known, whole)]
                if out:
                    key, side, owner = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(owner)], names=["key", "side", "id"])

    def _cut_keys(self, ids: np.ndarray, texts: list[str]):
        lengths = np.array([len(t) for t in texts])
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for tag, side, drop in self.cuts.get(int(length), ()):
                points = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32)
                points = points.reshape(len(rows), length).astype(np.uint64) + np.uint64(1)
                with np.errstate(over="ignore"):
                    weights = np.cumprod(np.full(length - drop, _ODD, np.uint64))
                    found = np.stack(
                        [(points[:, kept] * weights).sum(axis=1, dtype=np.uint64) for kept in map(list, combinations(range(length), length - drop))]
                    )
                    found = np.sort((found + np.uint64(tag)) * _ODD, axis=0)
                    found ^= found >> np.uint64(32)
                new = np.concatenate([np.ones((1, len(rows)), bool), found[1:] != found[:-1]])
                owner = np.broadcast_to(ids[rows], found.shape)[new]
                yield found[new].view(np.int64), np.full(len(owner), side, np.int8), owner

    def _gram_keys(self, ids: np.ndarray, texts: list[str], known: dict[tuple[int, str], int], whole: bool):
        key, sides, owner = [], [], []
        missing = 0 if whole else 1
        for row, text in zip(ids, texts, strict=True):
            for tag, side, other, shared, level in self.grams.get(len(text), ()):
                grams = self._distinct(text)
                own = len(text)
                chance = {g: known.get((own, g), missing) * known.get((other, g), missing) for g in grams}
                ordered = sorted(grams, key=lambda g: (chance[g], g))
                least = max(1, shared - (own - self.q + 1 - len(grams)))
                for k in range(min(level, least), level + 1) if level else (0,):
                    # a gram that the other length never shows cannot be part of a meeting
                    prefix = [g for g in ordered[: len(grams) - least + k] if chance[g]]
                    found = [_text_key(tag, c) for c in combinations(prefix, k)]
                    key += found
                    sides += [side] * len(found)
                    owner += [row] * len(found)
        if key:
            yield np.array(key, np.int64), np.array(sides, np.int8), np.array(owner, np.int64)


_ODD = np.uint64(0x9E3779B97F4A7C15)
# Grams that a key combines, at most.
MOST_GRAMS = 6
# Keys that a task packs at a time.
SKETCHED = 1 << 21
# Bytes of the marks of all buckets together, at most; every task gets them.
MARKS = 1 << 24


def _parted(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the four bytes that stand for a key in it."""
    key = key.view(np.uint64)
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), key.astype(np.uint32)


def _bucketed(keys: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    bucket, rest = _parted(np.concatenate(keys), buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, rest = bucket[order], rest[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    packed = [part.tobytes() for part in np.split(rest, starts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(packed, pa.binary())], names=["bucket", "keys"])


def _places(rest: np.ndarray, size: int) -> np.ndarray:
    """The bit of a key among the ``size`` bytes of its bucket."""
    return ((rest * np.uint32(0x9E3779B1)) ^ (rest >> np.uint32(15))) % np.uint32(8 * size)


def repeated_marks(size: int) -> Callable[[pa.Table], pa.Table]:
    """(bucket, keys) rows of one bucket to (bucket, marks): a bit for what occurs more than once."""

    def marks(rows: pa.Table) -> pa.Table:
        rest = np.sort(np.concatenate([np.frombuffer(k, np.uint32) for k in rows.column("keys").to_pylist()]))
        bits = np.zeros(8 * size, bool)
        bits[_places(rest[1:][rest[1:] == rest[:-1]], size)] = True
        found = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        return pa.table({"bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int32()), "marks": pa.array([found], pa.binary())})

    return marks


def _marked(key: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bucket, rest = _parted(key, len(marks))
    place = _places(rest, marks.shape[1])
    return (marks[bucket, place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8)) & 1 > 0


def _text_key(tag: int, grams: tuple[str, ...]) -> int:
    return int.from_bytes(blake2b("\x01".join((str(tag), *grams)).encode(), digest_size=8).digest(), "little", signed=True)


TITLE = Threshold(1, 10, q=3)  # ratio > 0.9
COMPANY = Threshold(3, 20, q=2)  # ratio > 0.85
