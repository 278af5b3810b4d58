"""Every operator beside a plain version of its definition, and on odd tables."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.llm import attention_lm, common, ego_join, licenses, mixing, parity_join, pii, sharding, toxicity, warc, winnow
from jobloom.llm import queries as Q

ODD_SCHEMA = "doc_id long, text string, lang string, source string, _text string, key string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, and columns named like helpers."""
    long = " ".join(f"w{i % 977}" for i in range(60000)) + "a" * 200000
    rows = [
        (1, "a b c d e f", "en", "x", "t", "k", 1), (1, "a b c d e f", "en", "x", "t", "k", 1), (2, None, None, None, None, None, None),
        (3, "", "en", "y", "t", "k", 1), (None, "a b c d e f", "en", "x", "t", "k", 1), (None, None, "en", None, "t", "k", 1),
        (4, long, "en", "y", "t", "k", 1), (5, long, "en", "z", "t", "k", 1), (6, " \n\t", "en", "z", "t", "k", 1), (1, "other words here", "en", "x", "t", "k", 1),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


# ---- op1


def test_shards_match_a_walk_document_by_document(spark, docs, sf):
    rows = Q.op1_bounded_ring(spark, sf).collect()
    n = len(rows)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    # one document at a time: the first point clockwise whose shard has room
    cells = {r["doc_id"]: r["c"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(sharding.CELLS)).alias("c")).collect()}
    at, owner = sharding.ring(40)
    room = [n // 40 + (s < n % 40) for s in range(40)]
    placed = {}
    for cell in sorted(set(cells.values()), key=lambda c: hashlib.md5(str(c).encode()).digest()):
        for doc in sorted(d for d, c in cells.items() if c == cell):
            p = int(np.searchsorted(at, cell)) % len(at)
            while not room[owner[p]]:
                p = (p + 1) % len(at)
            room[owner[p]] -= 1
            placed[doc] = int(owner[p])
    assert placed == {r["doc_id"]: r["shard"] for r in rows}


def test_shards_of_odd_tables(odd, empty):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == 10 and sorted(Counter(r["shard"] for r in rows).values()) == [3, 3, 4]
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    assert sharding.shard(empty, 3).collect() == []


# ---- op2


def plain_base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


TRICKY = [
    "a@b.c@d.e x@y x@y. z@q.com. .@a.b é@a.bé a.b-c+d%e_f@x-y.z-1.co,", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 999.1.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 5 4111111111111111 41111111111111112", "+1 (555) 555-0123 +12 +1 2 +123456789012345678 +1..2345678 9",
    "call 555-123-4567 or (555) 123-4567; mail joe [at] example [dot] com", "", "@", "+", "1" * 50, "ünï 4111111111111111 ☃@a.b x☃y@a.b",
]


def test_base_spans_equal_the_patterns(docs):
    for text in [*TRICKY, *(r["text"] for r in docs.collect())]:
        got = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text))
        assert got == plain_base(text), text[:80]


def test_pii_query(spark, docs, sf):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = Q.op2_weak_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base.split(",")) - {""} <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in base.split(",")) for k in pii.KINDS]


def test_pii_adds_announced_spans_and_odd_tables(spark, odd, empty):
    rows = [(i, t) for i, t in enumerate([*TRICKY, *["mail bob@example.com or call +1 (555) 555-0123 today"] * 40, *["email: ann [at] example [dot] com", "tel 555-123-4567"] * 5])]
    found, model = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r["n_added"] for r in found.collect()) >= 10 and model.reliability["bounded"][0] > 0.5
    rows = pii.spans(odd)[0].collect()
    assert len(rows) == 10 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.spans(empty)[0].collect() == []


def test_long_words_cost_nothing():
    text = "a" * 300000 + "1" * 300000
    assert pii.base_spans(text) == [] and pii.more_spans(text, []) == []


# ---- op3 (SQL checks the query)


def plain_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[j : j + n]:
                    hit.update(range(i, i + n))
                    ids.add(item_id)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def test_contamination_with_short_items_and_repeats(spark, odd, empty):
    base = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(base[:25])), (2, "short item"), (3, "Solo"), (4, ""), (5, None), (10, "x x x x x x x x x x x"), (None, "a b c d e f"), (2, "second text")]
    texts = [
        " ".join(base), " ".join(base[3:13]), " ".join(base[3:12]), "a SHORT, item! short item", "solo", "soloist", "x " * 30, "x " * 9, None, "", "é short item é",
        " ".join(base[:9] + ["z"] + base[10:25]), "second text here", "pre " + " ".join(base[15:25]) + " short",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in winnow.contamination(docs, bench).collect()}
    named = [i for i in items if i[0] is not None]
    assert got == {i: plain_hits(t, named) for i, t in enumerate(texts)}
    assert {r["doc_id"] for r in winnow.keep_clean(docs, bench).collect()} == {i for i, v in got.items() if not v[4]}
    rows = winnow.contamination(odd, spark.createDataFrame([(7, "c d e")], "item_id long, text string")).collect()
    assert len(rows) == 10 and sum(r["contaminated"] for r in rows) == 3
    assert not any(r["contaminated"] for r in winnow.contamination(odd, bench.limit(0)).collect())
    assert winnow.contamination(empty, bench).collect() == []
    assert winnow.keep_clean(odd, spark.createDataFrame([(7, "c d e")], "item_id long, text string")).columns == odd.columns


# ---- op4


def test_archives_round_trip(spark, sf):
    pages = common.table(spark, sf, "pages").collect()
    rows = {r["page_id"]: r for r in Q.op4_warc_shards(spark, sf).collect()}
    first = defaultdict(lambda: math.inf)
    for p in pages:
        first[p["html"]] = min(first[p["html"]], p["page_id"])
    assert len(rows) == len(pages)
    for p in pages:
        raw, r = (p["html"] or "").encode(), rows[p["page_id"]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        leader = first[p["html"]]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if leader == p["page_id"] else ("revisit", leader))


def test_archives_are_the_same_bytes_and_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string, shard int, _first long"
    rows = [(i, f"http://h/{i % 7}\r\nX: y", f"page {i % 50} " * 40, 1, 1) for i in range(400)] + [(900, None, None, 1, 1), (901, "u", "", 1, 1), (None, "u", "page 1 " * 40, 1, 1), (3, "v", "page 3 " * 40, 1, 1), (10**17, "far", "x", 1, 1)]
    hashes = []
    for run in "ab":
        folder = f"file://{tmp_path}/{run}"
        manifest = warc.write(spark.createDataFrame(rows, schema).repartition(5 + len(hashes)), folder, target_bytes=20000, roll_bytes=4000)
        files = sorted((r["name"], r["sha256"], r["records"]) for r in manifest.collect())
        assert len(files) > 5 and all(hashlib.sha256(open(f"{tmp_path}/{run}/{n}", "rb").read()).hexdigest() == h for n, h, _ in files)
        hashes.append(files)
        got = warc.read(spark, folder, manifest).collect()
        assert len(got) == len(rows)
    assert hashes[0] == hashes[1]
    by_id = defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert by_id[900] == [("response", None)] and by_id[901] == [("revisit", 900)] and by_id[None] == [("revisit", 1)]
    assert by_id[3] == [("response", None)] * 2 and by_id[53] == [("revisit", 3)]
    folder = f"file://{tmp_path}/none"
    assert warc.read(spark, folder, warc.write(spark.createDataFrame([], schema), folder)).collect() == []


def test_a_repeated_commit_finds_its_files(spark, tmp_path):
    folder = f"file://{tmp_path}/again"
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    batches = spark.read.parquet(f"{folder}/manifest-1").toArrow().to_batches()
    assert sum(len(b) for b in warc._commit(iter(batches), folder)) == 1


# ---- op5


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in Q.op5_label_model(spark, sf).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in common.table(spark, sf, "labels").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [(rows[d]["predicted"], t) for d, t in labels if rows[d]["held_out"]]
    right = sum(p == t for p, t in held) / len(held)
    assert right >= 0.97 and sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)


def test_toxicity_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, 1), (4, 0, None), (5, 7, 7)], "doc_id long, quality int, toxic int")
    assert len(toxicity.scores(odd, labels).collect()) == 10
    assert {r["score"] for r in toxicity.scores(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(empty, labels).collect() == []
    kept = toxicity.keep_clean(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 10


# ---- op6 (SQL checks the query)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 10))
    vectors = [centers[i % 12] + rng.normal(size=10) * (0.05 + 0.03 * (i % 9)) for i in range(700)]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(700 + i, [float(x) * 2 for x in vectors[5]], 1) for i in range(40)]
    odd = [None, [], [0.0] * 10, [1.0, None] + [0.0] * 8, [math.nan] + [1.0] * 9, [math.inf] + [1.0] * 9, [1.0, 0.0], [1.0, 0.0], [1e300] * 10]
    rows += [(800 + i, v, 1) for i, v in enumerate(odd)] + [(None, [1.0] * 10, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int").repartition(7)
    ok = {i: v for i, v, _ in rows if i is not None and v and len(v) == 10 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    x = np.array([[c / max(map(abs, ok[i])) for c in ok[i]] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = {i: (0, i) for i, _, _ in rows if i is not None}
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want |= {i: (int(near[k].sum()) - 1, ids[label[k]]) for k, i in enumerate(ids)}
    want |= {806: (1, 806), 807: (1, 806)}
    old = ego_join.BLOCK, ego_join.LEAF
    ego_join.BLOCK, ego_join.LEAF = 100, 16
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ego_join.near_duplicates(frame, 0.9).collect()}
    finally:
        ego_join.BLOCK, ego_join.LEAF = old
    assert got.pop(None) == (0, None)
    assert got == want
    assert ego_join.near_duplicates(frame.limit(0)).collect() == []
    assert len(ego_join.near_duplicates(frame.where("vec_id is null or vec_id in (800, 802)")).collect()) == 3


# ---- op7 (SQL checks the query)


def plain_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in texts}
    changed = True
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in texts}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_similar_texts_against_all_pairs(spark, width, percent):
    rng = np.random.default_rng(width)
    word = lambda: f"w{rng.integers(400)}"
    passage = [word() for _ in range(60)]
    texts = {}
    for base in range(25):
        own = [word() for _ in range(int(rng.integers(1, 250)))]
        if base % 4 == 0:
            own += passage
        for _ in range(int(rng.integers(1, 12))):
            copy = list(own)
            for _ in range(int(rng.integers(0, 1 + len(own) // 12))):
                copy[rng.integers(len(copy))] = word()
            texts[len(texts)] = " ".join(copy).upper() if len(texts) % 5 == 0 else " ".join(copy)
    texts |= {1000: None, 1001: "", 1002: " ", 1003: "one", 1004: "One"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similar(frame, width, percent).collect()}
    assert got == plain_components(texts, width, percent)


def test_no_similar_pair_shares_no_key():
    rng = np.random.default_rng(0)
    for percent in (50, 80, 90):
        place = {}
        for _ in range(1500):
            n = int(rng.integers(1, 300))
            both = rng.integers(0, 2**63, n).astype(np.uint64)
            most = parity_join.allowed(n + 5, percent)
            cut, more = int(rng.integers(0, most + 2)), int(rng.integers(0, most + 2))
            a, b = np.unique(both), np.unique(np.append(both[cut:], rng.integers(0, 2**63, more).astype(np.uint64)))
            same = len(np.intersect1d(a, b))
            if len(b) and 100 * same >= percent * (len(a) + len(b) - same):
                assert set(parity_join.block_keys(a, percent, place)) & set(parity_join.block_keys(b, percent, place))


def test_similar_odd_tables(odd, empty):
    rows = parity_join.similar(odd).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter({(1, 1): 3, (2, 2): 1, (3, 3): 1, (None, None): 2, (4, 4): 1, (5, 4): 1, (6, 6): 1})
    assert parity_join.similar(empty).collect() == []
    kept = parity_join.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, None: 2, 4: 1, 6: 1})


# ---- op8 (SQL checks the query)


def test_license_rules(spark, odd, empty):
    texts = [
        "Foo.\nReleased under the MIT License.\nbar", "licensed UNDER the Apache License, Version 2.0!", "Redistributions in binary form must reproduce the above copyright notice. Redistributions of source code must retain the above copyright notice.",
        "Redistributions of source code must retain the above copyright notice.\n\nRedistributions in binary form must reproduce the above copyright notice.", "All rights reserved.", None,
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licenses"], r["unmatched"]) for r in rows] == [("MIT", False), ("Apache-2.0", False), ("", True), ("BSD-2-Clause", False), ("", True), ("", False)]
    assert licenses.scan(odd).count() == 10 and licenses.scan(empty).collect() == []


# ---- op9


def test_base_scores_and_probabilities(spark, docs, sf):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + [None]
    counts = Counter(w for d, t in texts.items() if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    old = attention_lm.SENT_WORDS
    for sent in (old, 50, 0):
        attention_lm.SENT_WORDS = sent
        try:
            rows = Q.op9_attention_lm(spark, sf).collect() if sent != old else (first := Q.op9_attention_lm(spark, sf).collect())
        finally:
            attention_lm.SENT_WORDS = old
        for r in rows:
            w = words(texts[r["doc_id"]])
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and -math.inf < r["score"] < 0
        assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx({r["doc_id"]: r["score"] for r in first})


def test_model_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    attention_lm_own = attention_lm.OWN
    counts = rng.integers(1, 100, 300).astype(float)
    windows = rng.integers(0, 300, (2000, attention_lm.WINDOW + 1))
    windows[:, 1::2] = windows[:, 0:-1:2]  # every other id repeats the one before
    model = attention_lm.Model(counts, windows, epochs=4)
    assert attention_lm.OWN == attention_lm_own
    end = 299
    prefix = rng.integers(0, 299, 45)
    # p(text) is the sum over all next ids of p(text, id), each with whatever follows; for a model whose
    # end is one of the ids, prefix scores without the end are what longer texts share
    def without_end(text):
        # log10 p(text): the score of a longer text minus what follows cannot be had from outside,
        # so sum the last step: p(end | text) + sum over i of p(i | text) = 1
        text = text.astype(np.uint16)
        ended = 10.0 ** model.scores([text], end)[0]
        return ended

    short = prefix[:1]
    lone = {i: without_end(np.array([i])) for i in range(0, 299, 50)}
    assert all(0 < p < 1 for p in lone.values()) and 0 < without_end(short) < 1
    assert model.scores([prefix[:0].astype(np.uint16)], end)[0] < 0
    # batches do not matter
    many = [rng.integers(0, 299, int(k)).astype(np.uint16) for k in rng.integers(0, 80, 200)]
    assert model.scores(many, end) == pytest.approx(np.array([model.scores([m], end)[0] for m in many]))


def test_training_uses_every_window_of_every_text():
    """Each id and each end is predicted in some window, those of short texts and last windows included."""
    end, texts = 299, [np.arange(1, 1 + n, dtype=np.uint16) for n in (0, 3, 15, 16, 40, 200)]
    windows, left = attention_lm._windows(texts, end)
    at, seen = 0, []
    for t in texts:
        line = [end, *t.tolist(), end]
        count = int(attention_lm._starts(np.array([len(t) + 1]))[0])
        predicted = set()
        for k in range(count):
            start = k * (attention_lm.WINDOW - attention_lm.OVERLAP)
            n = int(left[at])
            assert windows[at, : n + 1].tolist() == line[start : start + n + 1]
            predicted |= set(range(start + 1, start + n + 1))
            at += 1
        assert predicted == set(range(1, len(line)))
        seen.append(count)
    assert at == len(windows) == sum(seen)
    model = attention_lm.Model(np.arange(1.0, 301.0))
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], names=["ids"])
    made = list(attention_lm._trained(iter([batch]), model, [0.01], end))
    assert made[0].column("n").to_pylist() == [len(windows)]


def _plain_step(w, x, y, use, rate, step, first, second):
    """One step of training written out, place by place and without any array that is used again."""
    d, size = attention_lm.WIDTH, attention_lm.WINDOW
    mask = np.where(np.tril(np.ones((size, size), bool)), 0, -1e9).astype(np.float32)
    e = w["E"][x] + w["P"]
    q, k, v = e @ w["Q"], e @ w["K"], e @ w["V"]
    a = q @ k.transpose(0, 2, 1) / np.float32(np.sqrt(d)) + mask
    a = np.exp(a - a.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    h = np.concatenate([a @ v, e], axis=2)
    z = h @ w["O"] + w["b"]
    p = np.exp(z - z.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    np.put_along_axis(p, y[..., None], np.take_along_axis(p, y[..., None], 2) - 1, 2)
    p *= use[..., None] / np.float32(use.sum())
    flat = lambda t: t.reshape(-1, t.shape[-1])
    dh = p @ w["O"].T
    dc, de = dh[..., :d], dh[..., d:].copy()
    da, dv = dc @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dc
    ds = a * (da - (da * a).sum(axis=2, keepdims=True)) / np.float32(np.sqrt(d))
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    de += dq @ w["Q"].T + dk @ w["K"].T + dv @ w["V"].T
    g = {"O": flat(h).T @ flat(p), "b": flat(p).sum(axis=0), "P": de.sum(axis=0), "E": np.zeros_like(w["E"])}
    g |= {n: flat(e).T @ flat(t) for n, t in (("Q", dq), ("K", dk), ("V", dv))}
    np.add.at(g["E"], x.ravel(), flat(de))
    for n in w:
        first[n] = 0.9 * first[n] + 0.1 * g[n]
        second[n] = 0.99 * second[n] + 0.01 * g[n] ** 2
        w[n] -= np.float32(rate) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)


def _plain_score(model, ids, end):
    w, size, d, total, at = model.w, attention_lm.WINDOW, attention_lm.WIDTH, 0.0, 0
    line = np.array([end, *ids.tolist(), end])
    while at < len(line) - 1:
        part = line[at : at + size + 1]
        e = (w["E"][model.row[part[:-1]]] + w["P"][: len(part) - 1]).astype(float)
        a = (e @ w["Q"]) @ (e @ w["K"]).T / np.sqrt(d)
        a = np.where(np.tril(np.ones(a.shape, bool)), a, -np.inf)
        a = np.exp(a - a.max(axis=1, keepdims=True))
        z = np.concatenate([a / a.sum(axis=1, keepdims=True) @ (e @ w["V"]), e], axis=1) @ w["O"] + w["b"]
        z -= z.max(axis=1, keepdims=True)
        logs = (z[np.arange(len(z)), model.klass[part[1:]]] - np.log(np.exp(z).sum(axis=1))) / np.log(10) + model.within[part[1:]]
        total += logs[attention_lm.OVERLAP if at else 0 :].sum()
        if at + size >= len(line) - 1:
            break
        at += size - attention_lm.OVERLAP
    return total


@pytest.mark.parametrize("scale", [1, 40])
def test_training_and_scores_equal_the_plain_formulas(scale):
    """Odd numbers of windows, short texts, and weights so large that exponents must be shifted."""
    rng = np.random.default_rng(3)
    counts, end = rng.integers(1, 100, 300).astype(float), 299
    texts = [rng.integers(0, 299, int(n)).astype(np.uint16) for n in (0, 1, 15, 16, 17, 300, 4000, 40)]
    windows, left = attention_lm._windows(texts, end)
    assert len(windows) > attention_lm.BATCH and len(windows) % 16
    model, rate = attention_lm.Model(counts), 0.01
    for k in ("Q", "K", "O"):
        model.w[k] *= np.float32(scale)
    w = {k: v.copy() for k, v in model.w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.random.default_rng(7).permutation(len(windows))
    for step, at in enumerate(range(0, len(order), 256), 1):
        rows = order[at : at + 256]
        _plain_step(w, model.row[windows[rows, :-1]], model.klass[windows[rows, 1:]], np.arange(attention_lm.WINDOW) < left[rows, None], rate, step, first, second)
    model.train(windows, left, rate, model.start(), np.random.default_rng(7))
    for k in w:  # a step of the optimizer is about the rate, whatever the gradient
        assert np.quantile(np.abs(model.w[k] - w[k]), 0.98) < 0.02 * rate, k
    assert model.scores(texts, end) == pytest.approx([_plain_score(model, t, end) for t in texts], rel=1e-4)
    nothing = np.zeros((0, attention_lm.WINDOW + 1), np.int64)
    model.train(nothing, np.zeros(0, np.int64), rate, model.start(), np.random.default_rng(7))


def test_training_takes_less_cpu_than_the_plain_formula():
    rng = np.random.default_rng(4)
    model = attention_lm.Model(rng.integers(1, 100, 5000).astype(float))
    windows = rng.integers(0, 5000, (1024, attention_lm.WINDOW + 1))
    left, w = np.full(1024, attention_lm.WINDOW), {k: v.copy() for k, v in model.w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def plain():
        for at in range(0, 1024, 256):
            x, y = model.row[windows[at : at + 256, :-1]], model.klass[windows[at : at + 256, 1:]]
            _plain_step(w, x, y, np.arange(attention_lm.WINDOW) < left[at : at + 256, None], 0.01, 1, first, second)

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    slow, fast = (min(seconds(f) for _ in range(7)) for f in (plain, lambda: model.train(windows, left, 0.01, model.start(), rng)))
    assert fast < 0.8 * slow


def test_long_texts_are_cut_where_the_pattern_cuts():
    coder = attention_lm.Subwords(open(attention_lm.VOCABULARY, "rb").read())
    for unit in ("alpha beta  gamma\n delta, ", "x", "mot été  \n"):
        text = unit * (200000 // len(unit))
        assert coder.coder.decode(coder.ids(text).tolist()) == text
        if unit != "x":
            assert coder.ids(text).tolist() == coder.coder.encode_ordinary(text)


def test_scores_of_odd_tables(odd, empty):
    rows = attention_lm.scores(odd).collect()
    assert len(rows) == 10 and all(np.isfinite(r["score"]) for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 6)} == {1}
    assert attention_lm.scores(empty).collect() == []


# ---- op10 (SQL checks the query)


def test_mix_keeps_its_promises(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", "c", None, "d", "d", "d"][i % 7]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3000 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    # the plain rule: weights by name, whatever is over its cap is dealt again
    names = [*sorted(s for s in targets if s is not None), None]
    weight = dict(zip(names, (5, 2, 1, 5, 2), strict=True))
    goal, free, left = {}, set(names), 1.5 * total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * targets[s][1]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 2 * targets[s][1]
            left -= goal[s]
        free -= over
    assert goal == pytest.approx({s: t for s, (t, _) in targets.items()})
    for s in names:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - goal[s]) <= 2 * 60
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert len(mixing.mix(odd).collect()) == 10 and mixing.mix(empty).collect() == []
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mix(nothing).collect()} == {0}
