"""The derived input tables of the registered queries, as SQL both engines read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import pin_utc

AS_OF = "2026-03-01 10:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

JOB_POSTINGS_SQL = """
WITH b AS (
  SELECT o_orderkey AS k, o_custkey AS ck, c_mktsegment AS seg,
         CAST(o_orderdate AS DATE) + INTERVAL 27 YEAR AS dl,
         substr(md5(CAST(o_custkey AS STRING)), 1, 12) AS org,
         substr(md5(CAST(o_orderkey % 97 AS STRING)), 1, 8) AS tag
  FROM orders JOIN customer ON o_custkey = c_custkey
), d AS (
  SELECT k, ck, seg, org, tag,
         CAST(year(dl) AS STRING) AS yy, lpad(CAST(month(dl) AS STRING), 2, '0') AS mm, lpad(CAST(day(dl) AS STRING), 2, '0') AS dd,
         CASE month(dl) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June'
           WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS mon
  FROM b
), p AS (
  SELECT k, 0 AS copy, seg, org, tag, yy, mm, dd, mon, ck FROM d
  UNION ALL
  SELECT k, 1 AS copy, seg, org, tag, yy, mm, dd, mon, ck FROM d WHERE k % 10 = 0
)
SELECT
  md5('https://jobs.example/' || CAST(copy AS STRING) || '/' || CAST(k AS STRING)) AS id,
  CASE WHEN copy = 1 THEN upper(role || ' ' || tag) ELSE role || '  ' || tag END AS title,
  CASE WHEN copy = 1 AND k % 3 = 0 THEN 'Partner ' || substr(md5(CAST(k AS STRING)), 1, 12)
       WHEN copy = 1 THEN 'Org ' || org || ' Ltd' WHEN ck % 7 = 0 THEN 'Org ' || org || ' (' || upper(substr(seg, 1, 4)) || ')' ELSE 'Org ' || org END AS company,
  role || ' wanted. ' || needs || ' Station: ' || place AS description,
  place AS location_raw,
  CASE (k + copy) % 4 WHEN 0 THEN 'boarda' WHEN 1 THEN 'boardb' WHEN 2 THEN 'boardc' ELSE 'boardd' END AS source,
  'https://jobs.example/' || CAST(copy AS STRING) || '/' || CAST(k AS STRING) AS source_url,
  CASE k % 7 WHEN 0 THEN dd || '/' || mm || '/' || yy WHEN 1 THEN dd || ' ' || mon || ' ' || yy WHEN 2 THEN mon || ' ' || dd || ', ' || yy
       WHEN 3 THEN yy || '-' || mm || '-' || dd || 'T17:00:00+02:00' WHEN 4 THEN 'on ' || dd || '-' || mm || '-' || yy WHEN 5 THEN 'Ongoing' ELSE dd || '.' || mm || '.' || yy END AS deadline_raw,
  CAST('2026-02-20 06:00:00' AS TIMESTAMP) + (k % 240) * INTERVAL 1 HOUR AS scraped_at,
  k % 50 <> 49 AS is_active
FROM (SELECT p.*,
  CASE k % 12 WHEN 0 THEN 'Senior Accountant' WHEN 1 THEN 'Nurse' WHEN 2 THEN 'Software Engineer Intern' WHEN 3 THEN 'Country Director' WHEN 4 THEN 'Civil Engineer'
     WHEN 5 THEN 'Warehouse Contractor' WHEN 6 THEN 'HR Officer' WHEN 7 THEN 'Teacher' WHEN 8 THEN 'Monitoring and Evaluation Consultant' WHEN 9 THEN 'Driver' WHEN 10 THEN 'Communications Officer' ELSE 'Agronomist' END AS role,
  CASE k % 8 WHEN 0 THEN 'At least 3 years, Bachelor degree. Salary RWF 500,000 - 800,000.' WHEN 1 THEN '3 to 5 years experience, MBA preferred.' WHEN 2 THEN 'No prior experience needed. Permanent.'
     WHEN 3 THEN '2+ yrs. Pay: USD 1500' WHEN 4 THEN 'PhD required; US citizens only.' WHEN 5 THEN 'Fixed-term, 7 years in the field.' WHEN 6 THEN 'Diploma or TVET. Call 0788123456.' ELSE '' END AS needs,
  CASE ck % 6 WHEN 0 THEN 'Kigali, Rwanda' WHEN 1 THEN 'Huye' WHEN 2 THEN 'Remote' WHEN 3 THEN 'Gasabo / Hybrid' WHEN 4 THEN 'Musanze' ELSE 'Nairobi' END AS place
  FROM p) q
"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a task of text work, about; a task of so many takes seconds.
TASK_ROWS = 20_000


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """Deal rows out when the input has fewer splits than the session has cores or ``rows`` need.

    Text work is CPU-bound, so one small file would keep one core busy, and splits or
    shuffle partitions sized by bytes would leave millions of narrow rows to a task.
    Inputs with enough splits, as on a cluster, are returned as they are.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts) if rows or df.rdd.getNumPartitions() < parts else df


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings derived from orders and customers, in the shapes the boards publish.

    Rows are dealt out after the join, whose partitions are sized by bytes.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    booked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return spark.sql(
        JOB_POSTINGS_SQL.replace("FROM orders JOIN customer ON o_custkey = c_custkey", "FROM {booked}"),
        booked=spread(booked, max(1, orders.count())),
    )
