"""Fill-in-middle, removal of repeats and vector codes beside plain versions of their definitions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from jobloom.llm import common, fim, run_index, value_codes
from jobloom.llm import queries as Q

ODD_SCHEMA = "doc_id long, text string, lang string, source string, _text string, marks string, n int, doc int"


def sha(raw) -> str:
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids, and columns named like helpers."""
    long = " ".join(f"w{i % 977}" for i in range(60000)) + "é" * 2000
    rest = ("en", "x", "t", "k", 1, 1)
    rows = [(1, "a b☃c 😀", *rest), (1, "a b☃c 😀", *rest), (2, None, *[None] * 6), (3, "", *rest), (None, "a b", *rest), (None, None, *rest)]
    return [*rows, (4, long, *rest), (5, long, *rest), (6, "x" * 350, *rest), (6, "y" * 350, *rest), (7, "has <S> inside", *rest), (8, " \n\t", *rest)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


# ---- op11


def plain_fim(doc_id, text):
    t = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return doc_id, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fim_query_and_round_trip(spark, sf):
    docs = common.table(spark, sf, "documents").collect()
    want = {d["doc_id"]: plain_fim(d["doc_id"], d["text"]) for d in docs}
    rows = Q.op11_fim_arrow(spark, sf).collect()
    assert len(rows) == len(docs) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        w = want[r["doc_id"]]
        assert tuple(r)[:5] == w[:5] and r["output_sha256"] == sha(w[5])
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    assert all(r["restored_sha256"] == sha(texts[r["doc_id"]]) for r in rows)


def test_fim_of_odd_tables(odd, odd_rows, empty):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in fim.transform(odd).collect()), key=key)
    assert got == sorted((plain_fim(r[0], r[1]) for r in odd_rows), key=key)
    back = fim.transform(odd).select("doc_id", fim.restored(Q.F.col("output"), Q.F.col("form")).alias("t")).collect()
    assert sorted((r["doc_id"] or 0, r["t"]) for r in back) == sorted((r[0] or 0, r[1] or "") for r in odd_rows)
    assert fim.transform(empty).collect() == []
    assert {r["form"] for r in fim.transform(odd, rate=0).collect()} == {"plain"}


def test_long_texts_are_cut_in_segments(monkeypatch):
    monkeypatch.setattr(fim, "UNITS", 5)
    texts = ["", "aé☃😀b", "xyz" * 7, "😀" * 11, "hello"]
    first, second = np.array([0, 1, 6, 2, 5]), np.array([0, 3, 20, 10, 5])
    pieces = fim._segments(pa.array(["skipped", *texts]).slice(1), first, second)
    for i, t in enumerate(texts):
        assert [p[i].as_py() for p in pieces] == [t[: first[i]], t[first[i] : second[i]], t[second[i] :]]


def test_adjoining_sentinels_do_not_confuse():
    output = [plain_fim(i, "<<P <S< S> <M" * 3) for i in range(60)]
    assert all(o[2] == "plain" or all(o[5].count(s) == 1 for s in ("<P>", "<S>", "<M>")) for o in output)


# ---- op12


def plain_repeats(docs, length):
    """(removed runs, kept) of every (doc_id, text): string by string."""
    order = lambda d: (d is None, d)
    least = {}
    for d, t in docs:
        raw = (t or "").encode()
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w not in least or order(d) < order(least[w]):
                least[w] = d
    found = []
    for d, t in docs:
        raw = (t or "").encode()
        gone, seen = bytearray(len(raw)), set()
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if order(least[w]) < order(d) or w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        edges = [k for k in range(len(raw) + 1) if (k < len(raw) and gone[k]) != (k > 0 and bool(gone[k - 1]))]
        found.append((list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return found


def shown(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in rows))


def wanted(docs, length):
    return sorted((d is None, d or 0, len((t or "").encode()), runs, kept) for (d, t), (runs, kept) in zip(docs, plain_repeats(docs, length), strict=True))


def test_repeats_query_against_plain(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    want = {d: (len((t or "").encode()), sum(b - a for a, b in runs), len(runs), sha(kept)) for (d, t), (runs, kept) in zip(docs, plain_repeats(docs, 100), strict=True)}
    rows = Q.op12_run_index(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and sum(w[1] for w in want.values()) > 0


def test_repeats_of_odd_tables(odd, odd_rows, empty):
    docs = [(r[0], r[1]) for r in odd_rows]
    assert shown(run_index.remove_repeats(odd).collect()) == wanted(docs, 100)
    assert run_index.remove_repeats(empty).collect() == []


def spliced(seed, n):
    """Texts put together from shared passages, changed here and there."""
    rng = random.Random(seed)
    base = "".join(rng.choice("ab c☃d") for _ in range(900))
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(700)
            part = list(base[a : a + rng.randint(20, 200)])
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = rng.choice("abxyz")
            parts.append("".join(part))
        docs.append((rng.randrange(n), rng.choice(["", " "]).join(parts)))
    return docs


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_crowded_anchors_are_split(spark, monkeypatch, limit):
    monkeypatch.setattr(run_index, "LIMIT", limit)
    line = "this very line of more than thirty-two bytes stands in all of the texts. "
    rng = random.Random(7)
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + line + "".join(rng.choice("ab") for _ in range(5)) + line) for i in range(30)]
    docs += spliced(limit, 40)
    rows = run_index.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 80).collect()
    assert shown(rows) == wanted(docs, 80)


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(run_index, "CHUNK", 400)
    docs = [t.encode() for _, t in spliced(5, 30)] + [b"ab" * 700, b"", b"x" * 99, b"y" * 100]
    found = run_index.contexts(docs, 100)
    covered = [np.zeros(max(0, len(d) - 99), int) for d in docs]
    for row, first, last, place in zip(found.row, found.first, found.last, found.place, strict=True):
        covered[row][first : last + 1] += 1
        assert last <= place <= first + 100 - run_index.GRAM
    assert all((c == 1).all() for c in covered)


def test_index_is_the_transform_and_its_matches_are_the_longest():
    rng = random.Random(3)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        texts += texts[:2]
        index = run_index.build(texts)
        flat = []
        for k, t in enumerate(texts):
            flat += [c + len(texts) for c in t] + [k]
        suffixes = sorted(range(len(flat)), key=lambda i: flat[i:])
        before = [flat[i - 1] - len(texts) if i and flat[i - 1] >= len(texts) else 256 for i in suffixes]
        assert np.repeat(index.symbols, index.lengths).tolist() == before
        places = np.array([i for i in range(len(flat)) if flat[i] >= len(texts)])
        shared, to = index.matches(places)
        rank = {i: r for r, i in enumerate(suffixes)}
        for i, n, j in zip(places, shared, to, strict=True):
            above = suffixes[rank[i] - 1]
            assert j == above
            common_bytes = 0
            while flat[i + common_bytes] == flat[above + common_bytes]:
                common_bytes += 1
            assert n == common_bytes


# ---- op13


def plain_codes(rows, parts, entries, rounds, scale):
    """vec_id -> (code, error, label), and the books; rows are (vec_id, vector, label)."""
    kept = sorted((v, [int(np.floor(scale * np.float64(x))) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e))
    dims = len(kept[0][1]) // parts
    cut = lambda x: [x[p * dims : (p + 1) * dims] for p in range(parts)]
    books = [[cut(x)[p] for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    best = lambda p, piece: min((far(piece, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x, _ in kept:
                groups.setdefault(best(p, cut(x)[p])[1], []).append(cut(x)[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else old for k, old in enumerate(books[p])]
    found = {}
    for v, x, label in kept:
        near = [best(p, piece) for p, piece in enumerate(cut(x))]
        found[v] = ("".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), label)
    return found, books


def test_codes_query_against_plain(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in common.table(spark, sf, "embeddings").collect()]
    want, books = plain_codes(rows, 16, 64, 2, 256)
    got = Q.op13_value_codes(spark, sf).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {v: w[:2] for v, w in want.items()}
    by_label = {}
    for _, error, label in want.values():
        by_label[label] = by_label.get(label, 0) + error
    assert all(r["label_error"] == by_label[want[r["vec_id"]][2]] for r in got)
    assert {r["codebooks_sha256"] for r in got} == {sha(",".join(str(c) for b in books for e in b for c in e))}


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, x int, error int, _label int"
    rng = np.random.default_rng(1)
    good = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)], None if i % 3 else "a") for i in range(40)]
    good += [(50, good[3][1], "b"), (51, [-0.0] * 8, "b"), (52, [1e5] * 8, "a")]
    bad = [(60, None, "a"), (61, [], "a"), (62, [1.0] * 7 + [None], "a"), (63, [float("nan")] * 8, "a"), (64, [float("inf")] * 8, "a"), (65, [1.0] * 12, "a"), (66, [1.0] * 7, "a")]
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in good + bad], schema).repartition(3)
    coded, books = value_codes.compress(frame, parts=4, entries=8)
    want, plain = plain_codes(good, 4, 8, 2, 256)
    got = coded.collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {v: w[:2] for v, w in want.items()}
    assert books.tolist() == plain
    errors = {label: sum(w[1] for w in want.values() if w[2] == label) for label in (None, "a", "b")}
    assert all(r["label_error"] == errors[want[r["vec_id"]][2]] for r in got)
    repeated, _ = value_codes.compress(frame.where("vec_id in (1, 2)").unionByName(frame.where("vec_id = 1")), parts=4, entries=64)
    assert sorted(r["vec_id"] for r in repeated.collect()) == [1, 1, 2]
    for none in (frame.where("false"), frame.where("vec_id = 60")):
        coded, books = value_codes.compress(none, parts=4)
        assert coded.collect() == [] and books is None
    with pytest.raises(Exception, match="a component is"):
        value_codes.compress(spark.createDataFrame([(1, [1e30] * 8, "a")], "vec_id long, embedding array<float>, label string"), parts=4)


@pytest.mark.parametrize("links", [
    [],
    [(1, 2), (1, 3), (1, 4)],
    [(k, k + 1) for k in range(1, 40)],
    [(9, k) for k in range(1, 9)] + [(20, 20), (30, 31), (31, 30), (40, 31)],
    [(k, 100) for k in range(101, 130)] + [(129, 7), (50, 51)],
])
def test_components_of_chains_hubs_and_stars(spark, links):
    from jobloom.llm.components import components

    low = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(low.items())
