"""Toxicity by weak supervision.

Terms (words, and beginnings of words for inflected forms) that a bounded sample of labelled rows
shows to be typical of toxic texts are dealt to voters; some more voters look at how many and how
dense they are.  A generative label model, fitted by expectation-maximisation on the vote
combinations of the whole corpus (a bounded table of counts), estimates each voter's accuracy and
how much voters repeat each other; its posteriors are the labels of a linear classifier, which
gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import crc_mod, slices, stored

#: Labelled rows of each class from which terms are learned, at most.
SAMPLE = 8000
#: Terms of the lexicons, at most, and the least share of toxic rows that hold one.
TERMS = 3000
LEAST_SHARE = 0.01
#: Terms that a task counts before it passes them on.
HELD_TERMS = 100_000
#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7)
#: Distinct feature rows on whose posteriors the classifier is trained, at most.
ROWS = 20000
DECISION = 0.3
#: Votes that the silence of all voters is worth.
SILENCE = 4

_WORD = re.compile(r"[^\W\d_]+")
#: Voters of each kind of term, and the voters on amounts.
GROUPS = {0: 3, **{n: 2 for n in STEMS}}
AMOUNTS = ("two terms", "three terms", "one in a hundred words")
N_VOTERS = sum(GROUPS.values()) + len(AMOUNTS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _terms(words: list[str]) -> set[tuple[int, str]]:
    distinct = set(words)
    found = {(0, w) for w in distinct}
    for n in STEMS:
        found.update((n, w[:n]) for w in distinct if len(w) >= n)
    return found


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each term, by class; sums are passed on whenever they fill up."""
    counts = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array([t[0] for t in terms], pa.int32()), pa.array([t[1] for t in terms], pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["kind", "term", "clean", "toxic"])

    for batch in batches:
        for _, rows in slices(batch):
            for text, toxic in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(_terms(words_of(text)))
                if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                    yield flush()
    yield flush()


def lexicon(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[dict[tuple[int, str], float], DataFrame]:
    """Typical terms of toxic texts with their log odds, and the labelled sample.

    ``usable`` says which doc_ids may be learned from.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    halves = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    sample = stored(halves[0].unionByName(halves[1]), "toxic-sample")  # at most 2 * SAMPLE rows
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_toxic or not n_clean:
        return {}, sample
    sums = rows.mapInArrow(_count_terms, "kind int, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.1) / (n_toxic + 1)) - F.log((F.col("clean") + 0.1) / (n_clean + 1))
    typical = sums.where(F.col("toxic") >= max(3, math.ceil(LEAST_SHARE * n_toxic))).select("kind", "term", odds.alias("odds")).where("odds > 4")
    best = typical.orderBy(F.desc("odds"), "kind", "term").limit(TERMS)
    return {(r["kind"], r["term"]): r["odds"] for r in best.collect()}, sample


class Voters:
    """Votes and features of texts under a lexicon."""

    def __init__(self, terms: dict[tuple[int, str], float]):
        self.groups: dict[tuple[int, str], int] = {}
        base = 0
        for kind, n in GROUPS.items():
            # terms of about the same strength share a voter
            own = sorted((t for t in terms if t[0] == kind), key=lambda t: (-terms[t], t))
            for i, t in enumerate(own):
                self.groups[t] = base + i * n // len(own)
            base += n
        self.words = {t[1] for t in terms if t[0] == 0}
        self.stems = [(n, {t[1] for t in terms if t[0] == n}) for n in STEMS]

    def features(self, text: str | None) -> tuple[int, list[float]]:
        """(vote bits, one number per voter)."""
        words = words_of(text)
        counts = Counter(words)
        hits = [0] * N_VOTERS
        toxic = self.words & counts.keys()
        for w in toxic:
            hits[self.groups[0, w]] += counts[w]
        toxic = set(toxic)
        for n, stems in self.stems:
            for w in [w for w in counts if w[:n] in stems] if stems else ():
                hits[self.groups[n, w[:n]]] += counts[w]
                toxic.add(w)
        total = sum(counts[w] for w in toxic)
        first = N_VOTERS - len(AMOUNTS)
        hits[first:] = [int(total >= 2), int(total >= 3), int(100 * total >= max(1, len(words)))]
        bits = sum(1 << i for i, h in enumerate(hits) if h)
        return bits, [math.log1p(h) for h in hits]


class LabelModel:
    """Posteriors of vote combinations, with voters' accuracies and correlations.

    ``counts`` has all rows by vote combination, ``known`` the labelled sample by combination and
    class.  Labelled rows keep their class; all others together weigh as much as these.
    """

    def __init__(self, counts: dict[int, int], known: dict[tuple[int, int], int], prior: float, rounds: int = 60):
        codes = np.array(sorted({*counts, *(c for c, _ in known)}), dtype=np.int64)
        n = np.array([counts.get(int(c), 0) for c in codes], float)
        fixed = [np.array([known.get((int(c), k), 0) for c in codes], float) for k in (0, 1)]
        # the sample holds as many rows of either class as it can; the prior puts that right
        fixed = [f / max(f.sum(), 1) * share for f, share in zip(fixed, (1 - prior, prior), strict=True)]
        n = n / max(n.sum(), 1)
        v = ((codes[:, None] >> np.arange(N_VOTERS)) & 1).astype(float)
        post = (fixed[1] + 1e-9 * prior) / (fixed[0] + fixed[1] + 1e-9)
        for _ in range(rounds):
            pos, neg = post * n + fixed[1], (1 - post) * n + fixed[0]
            yes = (pos @ v + 1e-4) / (pos.sum() + 2e-4)
            no = (neg @ v + 1e-5) / (neg.sum() + 2e-4)
            # voters that agree more than their accuracies explain share one say
            shared = np.zeros((N_VOTERS, N_VOTERS))
            for w, p in ((pos, yes), (neg, no)):
                off = v - p
                cov = (off * w[:, None]).T @ off / w.sum()
                shared += np.clip(cov / np.sqrt(np.outer(p * (1 - p), p * (1 - p))), 0, 1) * (w.sum() / (pos.sum() + neg.sum()))
            np.fill_diagonal(shared, 0)
            weight = 1 / (1 + shared.sum(axis=1))
            # a voter that stays silent mostly abstains: all silent voters together count as SILENCE votes
            silent = SILENCE * ((1 - v) @ np.log((1 - yes) / (1 - no))) / N_VOTERS
            odds = math.log(prior / (1 - prior)) + v @ (weight * np.log(yes / no)) + silent
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.accuracy, self.weight = list(zip(yes.tolist(), no.tolist(), strict=True)), weight
        self.posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))


def classifier(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 600) -> np.ndarray:
    """Weights (bias first) of a logistic regression on soft labels ``y`` of rows that occur ``n`` times.

    Both classes weigh as much in the fit; the bias is then set back to their true shares.
    """
    x = np.column_stack([np.ones(len(x)), x])
    toxic, clean = float((n * y).sum()), float((n * (1 - y)).sum())
    up, down = n * y / max(toxic, 1e-9) / 2, n * (1 - y) / max(clean, 1e-9) / 2
    w = np.zeros(x.shape[1])
    speed = np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed + x.T @ (p * (up + down) - up) + 1e-4 * w
        w = w - 0.2 * speed
    w[0] += math.log(max(toxic, 1e-9) / max(clean, 1e-9))
    return w


class Scorer:
    """Everything that a score of a text needs."""

    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))) if len(self.weights) else np.zeros(len(x))

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(np.array([self.voters.features(t)[1] for t in texts]).reshape(len(texts), N_VOTERS))


def _vote(batches: Iterator[pa.RecordBatch], voters: Voters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in slices(batch):
            found = [voters.features(t) for t in rows.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "bits", "x"])


def _apply(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("x").to_pylist()).reshape(len(batch), N_VOTERS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(x))], names=["doc_id", "score"])


def _keep(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in slices(batch):
            yield rows.filter(pa.array(scorer.score_texts(rows.column("text").to_pylist()) < DECISION))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> tuple[Scorer, DataFrame]:
    """The scorer, and the votes of every row of ``docs`` (doc_id, text) as a written table.

    ``labels`` has doc_id and toxic (0 or 1; other values and null are not used; of repeated rows the
    largest counts).  Without labelled rows of both classes every score is 0.
    """
    usable = crc_mod(F.col("doc_id"), 4) != 2 if usable is None else usable
    docs = docs.select("doc_id", "text")
    terms, sample = lexicon(docs, labels, usable)
    voters = Voters(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()
    voted = stored(docs.mapInArrow(lambda it: _vote(it, voters), f"doc_id {kind}, bits long, x array<double>"), "toxic-votes")
    if not voters.groups:
        return Scorer(voters, np.zeros(0)), voted
    counts = {r["bits"]: r["count"] for r in voted.groupBy("bits").count().collect()}  # at most 2^N_VOTERS rows
    share = labels.where("toxic in (0, 1)").where(usable).agg(F.avg("toxic")).first()[0] or 0.0
    known = voted.join(F.broadcast(sample), "doc_id").groupBy("bits", "toxic").count()
    model = LabelModel(counts, {(r["bits"], r["toxic"]): r["count"] for r in known.collect()}, min(max(share, 0.01), 0.5))
    # rows of one vote combination share a posterior; the most frequent feature rows, with their counts
    rows = voted.groupBy("x", "bits").count().orderBy(F.desc("count"), F.xxhash64("x"), "bits").limit(ROWS).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), N_VOTERS)
    y = np.array([model.posterior[r["bits"]] for r in rows])
    n = np.array([r["count"] for r in rows], float)
    return Scorer(voters, classifier(x, y, n) if len(x) else np.zeros(0)), voted


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learned from rows with crc32(doc_id) mod 4 != 2.

    Returns doc_id, held_out, score (0 to 1) and predicted (score >= 0.3).  Null and empty texts
    have no terms and get the score of a text without any; a null doc_id has crc32 of the empty
    text; repeated rows get equal scores; no rows give no rows; other columns are left out.
    """
    scorer, voted = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = voted.mapInArrow(lambda it: _apply(it, scorer), f"doc_id {kind}, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    scorer, _ = fit(docs, labels)
    return docs.mapInArrow(lambda it: _keep(it, scorer), docs.schema)
