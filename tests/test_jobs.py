"""Ingest, streaming, search plans and the check SQL."""

import re

import pytest
from pyspark.sql import functions as F

from check_oracle import compare, connect
from jobloom import vocab
from jobloom.functions import classify
from jobloom.operators import ingest, report, search
from jobloom.plans import fixtures, pipeline, queries
from jobloom.schema import NAMES, POSTING_SCHEMA
from jobloom.sources import feeds
from jobloom.sources.profiles import PROFILES, build_postings, with_facts
from jobloom.streaming.incremental import STORED_SCHEMA, ingest_batch, stream_ingest


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, r in queries.REGISTRY.items() if r.sql])
def test_query_matches_sql(spark, con, sf, name):
    rows, _ = compare(spark, con, name, sf)
    assert rows > 0


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batch") / "postings")
    queries.postings(spark, sf).write.parquet(path)
    return path


def test_ingest_twice_adds_nothing(spark, stored, tmp_path):
    batch = spark.read.parquet(stored)
    assert batch.columns == NAMES
    store, runs = str(tmp_path / "store"), str(tmp_path / "runs")
    first = ingest_batch(batch, store, runs, fixtures.as_of()).agg(F.sum("new"), F.sum("skipped")).head()
    second = ingest_batch(batch, store, runs, fixtures.as_of()).agg(F.sum("new"), F.sum("skipped")).head()
    assert tuple(first) == (1650, 0) and tuple(second) == (0, 1650)
    assert ingest.read_or_empty(spark, store, STORED_SCHEMA).count() == 1650
    log = spark.read.parquet(runs)
    assert log.count() == 8 and log.filter("status = 'completed'").count() == 8
    assert log.agg(F.sum("jobs_new")).head()[0] == 1650


def test_empty_batch_logs_no_run(spark, tmp_path):
    empty = spark.createDataFrame([], POSTING_SCHEMA)
    assert ingest_batch(empty, str(tmp_path / "s"), str(tmp_path / "r"), fixtures.as_of()).count() == 0
    assert not (tmp_path / "r").exists()


def test_stream_equals_batch(spark, stored, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    batch = spark.read.parquet(stored)
    batch.repartition(3).write.parquet(landing)
    for _ in range(2):
        q = stream_ingest(spark, landing, store, str(tmp_path / "runs"), str(tmp_path / "cp"), fixtures.as_of, files_per_trigger=1)
        q.awaitTermination(300)
        assert q.exception() is None
        batch.limit(50).write.mode("append").parquet(landing)  # known ids arrive again
    table = ingest.read_or_empty(spark, store, STORED_SCHEMA)
    assert table.count() == table.select("id").distinct().count() == 1650


def test_scan_pushes_filters(spark, stored, tmp_path):
    store = str(tmp_path / "store")
    ingest_batch(spark.read.parquet(stored), store, str(tmp_path / "runs"), fixtures.as_of())
    jobs = ingest.read_or_empty(spark, store, STORED_SCHEMA)
    hits = search.search(search.active_postings(jobs, fixtures.as_of()), search.Criteria(source="boarda", sector="Health"))
    plan = search.first_cards(hits)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PartitionFilters: [isnotnull(source" in plan
    assert "EqualTo(is_active,true)" in plan or "is_active" in plan.split("PushedFilters")[1]
    assert "description" not in plan.split("ReadSchema")[1]


def test_classification_stays_in_the_jvm(spark, sf):
    plan = queries.classify_all(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'Élan "x", y', None)], "id string, title string, note string")
    feeds.write_csv(df, str(tmp_path / "csv"))
    feeds.write_json(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).head().title == 'Élan "x", y'
    assert spark.read.json(str(tmp_path / "json")).select("title").head().title == 'Élan "x", y'


def test_rss_file(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<?xml version='1.0'?><rss><channel><item><title> A  B </title><link>https://x.example/job/world-bank-kigali-rwanda-contract-1/</link>"
        "<pubDate>Wed, 18 Mar 2026 10:00:00 +0000</pubDate></item><item><title>no link</title></item></channel></rss>"
    )
    rows = feeds.stubs_from_items(feeds.read_rss(spark, str(tmp_path / "feed.xml"))).collect()
    assert len(rows) == 1 and rows[0].company == "World Bank" and rows[0].posted_date == "on 18-03-2026" and rows[0].title == "A B"


def test_pipeline(spark, tmp_path):
    listing = """<div class="job"><a class="jtitle" href="https://unjobs.org/vacancies/{i}">{t}, NO-2, Kigali, Rwanda</a><br>{c} | Deadline: 7 January 2027</div>"""
    html = "".join(listing.format(i=i, t=t, c=c) for i, (t, c) in enumerate([("Nurse", "UNICEF"), ("Driver", "WFP"), ("Nurse", "UNICEF")]))
    pages = spark.createDataFrame([("https://unjobs.org/kgl", html)], "url string, html string")
    result = pipeline.run_pipeline(
        spark, {"unjobs": (pages, None), "broken": (pages, None)}, str(tmp_path / "store"), str(tmp_path / "runs"),
        str(tmp_path / "clean"), 1, fixtures.as_of(),
    )
    assert list(result.errors) == ["broken"]
    assert result.totals.head().asDict() == {"found": 3, "new": 3, "skipped": 0, "removed": 1, "final": 2}


def test_postings_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Narrow rows are few bytes, so tasks of text work are sized by rows, after the join."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 10)
    spark.range(1000).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "timestamp '1998-01-01 00:00:00' AS o_orderdate"
    ).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(5).selectExpr("id AS c_custkey", "'AUTO' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    made = fixtures.job_postings(spark, str(tmp_path))
    sizes = [len(p) for p in made.select("id").rdd.glom().collect()]
    # an order becomes one posting, every tenth a second one
    assert sum(sizes) == made.count() > 700 and max(sizes) <= 20


@pytest.mark.parametrize("many", [1, 48])
def test_first_keyword_equals_a_plain_search(spark, monkeypatch, many):
    """Overlapping, nested, repeated and odd needles, as one pattern and one by one."""
    monkeypatch.setattr(classify, "MANY", many)
    kmap = {"A": ["data officer", "officer", "ff"], "B": ["data", "$5 (", "é", "ta off", "officer"], "C": ["a", "cer x", "it", "ict "]}
    texts = ["", None, "officer", "data officer", "xdatax", "off", "cost $5 (net)", "café", "a", "OFFICER x", "line\nbreak data", "zzz", "it-data", "bit", "unit it", "ict x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for mode in (classify.SUBSTRING, classify.BOUNDARY_RAW, classify.BOUNDARY_STRIPPED):
        def inside(n, bounded, t):
            return re.search(rf"\b{re.escape(n)}\b", t) if bounded else n in t

        want = [next((c for n, c, bounded in classify.ranked(kmap, mode) if inside(n, bounded, t.lower())), None) if t else None for t in texts]
        got = df.select("i", classify.keyword_category("t", kmap, mode=mode).alias("c")).orderBy("i").collect()
        assert [r.c for r in got] == want


def test_a_long_table_is_one_pattern(spark):
    """137 keywords are not tested one by one."""
    plan = spark.range(1).select(classify.keyword_category(F.col("id").cast("string"), vocab.SECTOR))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "regexp_extract_all" in plan


def test_boards_share_place_and_pay(spark, sf):
    """Ten boards read place and pay in fewer ways than there are boards, and get what they get alone."""
    raw = fixtures.job_postings(spark, sf).withColumnRenamed("deadline_raw", "deadline").withColumn("salary_text", F.col("description"))
    shared = with_facts(raw, PROFILES.values())
    ways = [c for c in shared.columns if c.startswith(("_place_", "_pay_"))]
    assert len([c for c in ways if c.startswith("_pay_")]) == 2 and len(ways) < len(PROFILES)
    got = {r.source: r for r in queries.queries()["all_boards"](spark, sf).collect()}
    assert set(got) == set(PROFILES)
    for name, p in PROFILES.items():
        alone = build_postings(raw, p, fixtures.as_of())
        assert report.run_summary(alone).collect() == [got[name]]
        same = build_postings(shared, p, fixtures.as_of())
        assert same.exceptAll(alone).count() == 0 and same.count() == alone.count()
