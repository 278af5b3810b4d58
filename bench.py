"""Headline timings: one JSON line.  BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.

``build_table`` extracts and classifies every posting and stores the table; the report
queries read the stored table as a dashboard would; the rest reads the given tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobloom.operators import report, search  # noqa: E402
from jobloom.plans import queries as Q  # noqa: E402
from jobloom.plans.fixtures import as_of  # noqa: E402
from jobloom.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
DIRECT = [
    "parse_deadlines", "experience_and_salary", "bounded_keywords", "ingest_new", "ingest_counts",
    "distinct_text", "document_categories", "page_links", "page_text", "split_announcements",
    "exact_duplicate_units", "duplicate_leaders",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    store = os.path.join(tempfile.mkdtemp(prefix="run-"), "jobs")
    timed("build_table", lambda: Q.jobs(spark, SF_DIR).write.parquet(store))
    act = search.active_postings(spark.read.parquet(store), as_of())
    frames = report.insights(act, as_of())
    for name, df in frames.items():
        timed(f"insights_{name}", lambda df=df: run(df))
    timed("search_page", lambda: run(search.first_cards(search.search(act, Q.CRITERIA))))
    timed("job_cards", lambda: run(search.cards(act)))
    for name in DIRECT:
        timed(name, lambda n=name: run(Q.REGISTRY[n].run(spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
