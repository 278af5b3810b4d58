"""The pipeline's stages beside plain versions, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from jobloom.llm import common

from llm.test_operators import plain_components, plain_hits


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, (before, after) in list(seen.items())[:-1]:
        assert all(list(r.asDict()) == columns for r in after) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}

    before, after = seen["near_duplicates"]
    want = plain_components({r["doc_id"]: r["text"] for r in before}, 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in want.items() if i == c)

    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not plain_hits(r["text"], items)[4])

    before, after = seen["mixing"]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
    assert set(Counter(r["doc_id"] for r in after).values()) <= {1, 2}
    assert abs(sum(size[r["doc_id"]] for r in after) - 1.5 * sum(size.values())) <= 2 * max(size.values())

    before, after = seen["sharding"]
    counts = Counter(r["shard"] for r in after)
    assert len(before) == len(after) and max(counts.values()) - min(counts[s] for s in range(40)) <= 1


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"
    docs = common.table(spark, sf, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    assert sum(t for d, t in toxic.items() if d in kept) <= 0.1 * sum(toxic.values())
    assert sum(1 - t for d, t in toxic.items() if d not in kept) <= 0.02 * len(toxic)
