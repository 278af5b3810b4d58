"""Runs the registered queries beside their check SQL: python tests/check_oracle.py SF_DIR [names]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from jobloom.plans.fixtures import TABLES  # noqa: E402
from jobloom.plans.queries import REGISTRY  # noqa: E402
from jobloom.session import local_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def compare(spark, con, name, sf_dir):
    reg = REGISTRY[name]
    df = reg.run(spark, sf_dir)
    got = df.collect()
    if reg.sql is None:
        return len(got), None
    cur = con.execute(reg.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    a = sorted([tuple(norm(r[n]) for n in order) for r in got], key=repr)
    at = [names.index(n) for n in order]
    b = sorted([tuple(norm(r[i]) for i in at) for r in want], key=repr)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        raise AssertionError(f"{len(a)} vs {len(b)} rows; {order}; {diff}")
    return len(a), dict(zip(order, [dict(df.dtypes)[n] for n in order]))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for n in sys.argv[2:] or list(REGISTRY):
        t = time.time()
        try:
            rows, _ = compare(spark, con, n, sf)
            print(f"ok   {n} {rows} rows {time.time() - t:.1f}s {'' if REGISTRY[n].sql else '(rows only)'}", flush=True)
        except Exception as e:
            bad.append(n)
            text = str(e) if isinstance(e, AssertionError) else traceback.format_exc(limit=-3)
            print(f"FAIL {n}: {text[:1500]}", flush=True)
    print("failed:", bad)
