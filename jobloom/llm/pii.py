"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Strict patterns give the base spans, which always stay.  Looser patterns propose more spans of the
same kinds (obfuscated addresses, phone numbers without a country code).  Pattern, gazetteer and
context labelers vote on every span, base ones too.  Votes are counted per combination over the
whole corpus, a bounded table; expectation-maximisation on it estimates how reliable each labeler
is, and a logistic classifier trained on the resulting posteriors decides about each new span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, with possessive repetition where backing off cannot help.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_HIDDEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?i:at) ?[\])}] ?[A-Za-z0-9-]++"
    r"(?: ?[\[({] ?(?i:dot) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+"
)
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")

# Fixed values of the labelers: endings of host names, words that announce a value.
GAZETTEER = frozenset("com org net edu gov io co uk de fr es it nl info biz".split())
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mails?|contact|write|reach|address|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|ping|login)\b"),
    "card": re.compile(r"(?i)\b(?:cards?|credit|visa|mastercard|payment|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(?:phones?|tel|call|mobile|fax|cell|tel[eé]fono|t[eé]l[eé]phone|telefon)\b"),
}
#: Characters to the left in which a context word counts.
WINDOW = 40
SCANNED = tuple(f"{p}_{c}" for p in ("base", "more") for c in ("kind", "start", "end", "code"))
RESULT = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")
LABELERS = ("strict", "gazetteer", "context", "bounded", "plausible")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ so that long words cost nothing."""
    done = 0
    if "@" not in text:
        return
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start."""
    found = [(0, *m) for m in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that touch no base span."""
    found = []
    if "[" in text or "(" in text or "{" in text:
        found += [(0, *m.span()) for m in _HIDDEN_EMAIL.finditer(text)]
    found += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    return [s for s in found if not any(b[1] < s[2] and s[1] < b[2] for b in base)] if found else found


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> int:
    """A code of the kind and of one bit per labeler."""
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    last = re.split(r"[^A-Za-z]+", span)[-1].lower()
    bits = (
        strict,
        last in GAZETTEER if kind == 0 else kind == 1 or (bool(digits) and digits[0] in ("3456" if kind == 2 else "1234567")),
        bool(CONTEXT[KINDS[kind]].search(text, max(0, start - WINDOW), start)),
        (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()),
        len(set(digits)) > 3 if kind in (2, 3) else 6 <= len(span) <= 80,
    )
    return kind << len(bits) | sum(1 << i for i, b in enumerate(bits) if b)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.int32())
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            more = more_spans(text, base)
            for at, spans, strict in ((0, base, True), (4, more, False)):
                for i in range(3):
                    columns[at + i].append([s[i] for s in spans])
                columns[at + 3].append([votes(text, *s, strict) for s in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, lists) for c in columns)], names=["doc_id", *SCANNED])


class SpanModel:
    """EM over vote combinations, then a logistic classifier on their posteriors."""

    def __init__(self, counts: dict[int, int], rounds: int = 50, steps: int = 400):
        k = len(LABELERS)
        codes = np.array(sorted(counts), dtype=np.int64)
        n = np.array([counts[int(c)] for c in codes], dtype=float)
        v = (codes[:, None] >> np.arange(k)) & 1
        self.reliability = {}
        self.weights = np.zeros(1 + k)
        if not len(codes):
            return
        # two hidden classes; the strict pattern starts the class of true spans
        post = np.where(v[:, 0] == 1, 0.9, 0.1 + 0.6 * v[:, 1:].mean(axis=1))
        for _ in range(rounds):
            p = (post * n).sum() / n.sum()
            yes = ((post * n) @ v + 1) / ((post * n).sum() + 2)
            no = (((1 - post) * n) @ v + 1) / (((1 - post) * n).sum() + 2)
            odds = np.log(max(p, 1e-6) / max(1 - p, 1e-6)) + v @ np.log(yes / no) + (1 - v) @ np.log((1 - yes) / (1 - no))
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.reliability = {name: (float(a), float(b)) for name, a, b in zip(LABELERS, yes, no, strict=True)}
        x = np.column_stack([np.ones(len(v)), v])
        # what the strict pattern says is no feature: the classifier judges spans that lack it
        x[:, 1] = 0
        w, share = self.weights, n / n.sum()
        for _ in range(steps):
            miss = 1 / (1 + np.exp(-x @ w)) - post
            w = w - 2.0 * (x.T @ (share * miss) + 0.001 * w)
        self.weights = w

    def accepts(self, code: int) -> bool:
        bits = (code >> np.arange(len(LABELERS))) & 1
        bits[0] = 0
        return bool(self.weights[0] + bits @ self.weights[1:] > 0)


def _digests(batches: Iterator[pa.RecordBatch], model: SpanModel) -> Iterator[pa.RecordBatch]:
    known: dict[int, bool] = {}
    for batch in batches:
        out = []
        for bk, bs, be, _, mk, ms, me, mc in zip(*(batch.column(c).to_pylist() for c in SCANNED), strict=True):
            base = sorted(zip(bk, bs, be, strict=True))
            more = []
            for kind, start, end, code in zip(mk, ms, me, mc, strict=True):
                if code not in known:
                    known[code] = model.accepts(code)
                if known[code]:
                    more.append((kind, start, end))
            joined = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found) for found in (base, sorted(base + more))]
            out.append((*(bk.count(k) for k in range(4)), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(more)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *RESULT])


def spans(docs: DataFrame) -> tuple[DataFrame, SpanModel]:
    """Spans of personal data in every row of ``docs`` (doc_id, text), and the fitted model.

    The frame has doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as
    kind:start:end in code points, end exclusive) and n_added.  A null or empty text has no
    spans; repeated rows are scanned each; no rows give no rows; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in SCANNED)
    found = stored(docs.select("doc_id", "text").mapInArrow(_scan, schema), "pii-spans")
    codes = found.select(F.explode(F.concat("base_code", "more_code")).alias("code")).groupBy("code").count()
    model = SpanModel({r["code"]: r["count"] for r in codes.collect()})  # at most 4 kinds times 32 votes
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return found.mapInArrow(lambda it: _digests(it, model), schema), model
