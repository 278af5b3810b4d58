"""Registered queries: name -> (Spark query, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import vocab
from jobloom.functions import classify as C
from jobloom.functions import dates as D
from jobloom.functions import extract as X
from jobloom.functions import html as H
from jobloom.functions import text as T
from jobloom.operators import dedup, ingest, pages, positions, records, report, search
from jobloom.plans import oracle as O
from jobloom.plans.fixtures import AS_OF_SQL, as_of, job_postings, spread, table
from jobloom.schema import enforce, load_rows, to_decimal
from jobloom.session import dropped, written
from jobloom.sources.feeds import first_tier, json_envelope, rss_stubs
from jobloom.sources.profiles import PROFILES, SourceProfile, build_postings, with_facts

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        REGISTRY[run.__name__] = Registered(run, sql)
        return run

    return add


BASE = PROFILES["jobinrwanda"]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of the derived postings."""
    raw = job_postings(spark, sf_dir).withColumnRenamed("deadline_raw", "deadline").withColumn(
        "salary_text", F.col("description")
    )
    return build_postings(raw, BASE, as_of(), keep=("id", "source", "scraped_at", "is_active"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table: canonical records with parsed dates."""
    return postings(spark, sf_dir).withColumns(
        {"deadline": D.parse_date("deadline"), "posted_date": D.parse_date("posted_date")}
    )


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.active_postings(jobs(spark, sf_dir), as_of())


# --- market report ----------------------------------------------------------


@query(f"WITH {O.ACTIVE} SELECT sector, count(*) AS count FROM live GROUP BY sector")
def live_by_sector(spark, sf_dir):
    return report.by_sector(active(spark, sf_dir))


@query(f"WITH {O.ACTIVE} SELECT sector, count(*) AS count FROM live GROUP BY sector ORDER BY count DESC, sector LIMIT 10")
def top_sectors(spark, sf_dir):
    return report.by_sector(active(spark, sf_dir), 10)


@query(
    f"WITH {O.ACTIVE} SELECT source, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
    "FROM live GROUP BY source"
)
def live_by_source_share(spark, sf_dir):
    return report.with_share(report.by_source(active(spark, sf_dir)))


@query(f"WITH {O.ACTIVE} SELECT source, count(*) AS count FROM live GROUP BY source ORDER BY count DESC, source LIMIT 3")
def top_sources(spark, sf_dir):
    return report.by_source(active(spark, sf_dir), 3)


@query(f"WITH {O.ACTIVE} SELECT district, count(*) AS count FROM act GROUP BY district ORDER BY count DESC, district LIMIT 10")
def top_districts(spark, sf_dir):
    return report.by_district(active(spark, sf_dir), 10)


@query(f"WITH {O.JP} SELECT company, count(*) AS count FROM jp WHERE is_active GROUP BY company ORDER BY count DESC, company LIMIT 10")
def top_companies(spark, sf_dir):
    return report.by_company(active(spark, sf_dir))


@query(f"WITH {O.JP} SELECT CAST(scraped_at AS DATE) AS day, count(*) AS jobs FROM jp WHERE is_active GROUP BY 1")
def added_per_day(spark, sf_dir):
    return report.per_day(active(spark, sf_dir))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS jobs FROM events GROUP BY 1")
def events_per_day(spark, sf_dir):
    return report.per_day(table(spark, sf_dir, "events"), "ts")


_HAS = "{0} IS NOT NULL AND {0} <> '' AND upper({0}) <> 'EMPTY'"


@query(
    f"WITH {O.ACTIVE} SELECT education_level, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
    f"FROM act WHERE {_HAS.format('education_level')} GROUP BY education_level"
)
def education_share(spark, sf_dir):
    return report.with_share(report.by_education(active(spark, sf_dir)))


@query(
    f"WITH {O.ACTIVE} SELECT job_level, count(*) AS count FROM act WHERE {_HAS.format('job_level')} "
    "GROUP BY job_level ORDER BY count DESC, job_level LIMIT 10"
)
def level_counts(spark, sf_dir):
    return report.by_level(active(spark, sf_dir))


_BUCKET = """CASE WHEN contains(e, 'full') OR contains(e, 'permanent') THEN 'Full-time/Permanent'
  WHEN contains(e, 'contract') THEN 'Contract' WHEN contains(e, 'consult') THEN 'Consultancy'
  WHEN contains(e, 'intern') THEN 'Internship' WHEN contains(e, 'volunteer') THEN 'Volunteer'
  WHEN contains(e, 'tender') THEN 'Tender' ELSE 'Others' END"""


@query(
    f"WITH {O.ACTIVE}, e AS (SELECT lower(employment_type) AS e FROM act WHERE {_HAS.format('employment_type')}) "
    f"SELECT {_BUCKET} AS clean_type, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM e GROUP BY 1"
)
def employment_clean(spark, sf_dir):
    return report.with_share(report.by_employment_bucket(active(spark, sf_dir)))


@query(
    f"WITH {O.ACTIVE} SELECT count(*) AS total_live, count(*) FILTER (scraped_at >= {AS_OF_SQL} - INTERVAL 3 DAY) AS new_3_days, "
    "count(*) FILTER (days_to_deadline <= 2) AS expiring_2_days FROM live"
)
def headline_cards(spark, sf_dir):
    return report.headline(active(spark, sf_dir), as_of())


@query(
    f"WITH {O.ACTIVE} SELECT count(*) AS total, count(DISTINCT CASE WHEN days_to_deadline >= 0 THEN sector END) AS sectors, "
    "count(DISTINCT CASE WHEN days_to_deadline >= 0 THEN source END) AS sources, "
    "least(count(DISTINCT company), 10) AS top_employers FROM act"
)
def insight_cards(spark, sf_dir):
    return report.insight_cards(active(spark, sf_dir))


@query(f"""WITH {O.ACTIVE},
 s AS (SELECT sector v, count(*) n FROM live GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
 o AS (SELECT source v, count(*) n FROM live GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
 d AS (SELECT district v, count(*) n FROM act GROUP BY 1 ORDER BY n DESC, v LIMIT 1)
SELECT (SELECT v FROM s) AS top_sector, (SELECT n FROM s) AS top_sector_jobs, (SELECT v FROM o) AS top_source,
 (SELECT n FROM o) AS top_source_jobs, (SELECT v FROM d) AS top_district, (SELECT n FROM d) AS top_district_jobs,
 (SELECT count(*) FROM act) AS total""")
def market_summary(spark, sf_dir):
    return report.market_summary(active(spark, sf_dir))


@query(f"WITH {O.JP} SELECT count(*) AS total_jobs, count(*) FILTER (is_active) AS active_jobs FROM jp")
def table_stats(spark, sf_dir):
    return report.table_stats(jobs(spark, sf_dir))


@query(f"WITH {O.JP} SELECT source, count(*) AS count FROM jp WHERE is_active GROUP BY source")
def active_by_source(spark, sf_dir):
    return report.active_by_source(jobs(spark, sf_dir))


_CLASSIFIED = f"""{O.JOBS}, c AS (SELECT jobs.*, jp.deadline_raw,
  {O.salary_min('jp.description')} IS NOT NULL AS disclosed,
  contains(lower(jp.location_raw), 'remote') AS is_remote,
  {O.eligibility('rwanda_eligible').replace('title', 'jp.title').replace('description', 'jp.description').replace('location_raw', 'jp.location_raw')} AS eligible
  FROM jobs JOIN jp USING (id))"""


@query(f"""WITH {_CLASSIFIED} SELECT source, count(*) AS total, count(*) FILTER (eligible) AS eligible,
 count(*) FILTER (disclosed) AS disclosed, count(*) FILTER (is_remote) AS remote, count(*) FILTER (deadline_raw <> '') AS with_deadline,
 count(*) FILTER (education_level <> '') AS with_education, count(*) FILTER (sector = 'Tender') AS tenders,
 count(*) FILTER (sector <> 'Tender') AS jobs FROM c GROUP BY source""")
def run_summary(spark, sf_dir):
    return report.run_summary(postings(spark, sf_dir))


@query(f"""WITH {O.JOBS}, u AS (
  SELECT source, 'sector' AS dimension, sector AS value, 5 AS size FROM jobs UNION ALL
  SELECT source, 'employment_type', employment_type, 5 FROM jobs UNION ALL
  SELECT source, 'job_level', job_level, 5 FROM jobs UNION ALL
  SELECT source, 'company', company, 6 FROM jobs),
 n AS (SELECT source, dimension, value, size, count(*) AS count FROM u GROUP BY ALL)
SELECT source, dimension, value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, dimension ORDER BY count DESC, value) AS rank FROM n) WHERE rank <= size""")
def run_top_values(spark, sf_dir):
    return report.run_top_values(postings(spark, sf_dir))


_TENDER_SQL = O.keyword("description", vocab.sector_with_tender(vocab.TENDER_PORTAL), "title")


@query(
    f"WITH {O.JP}, c AS (SELECT coalesce({_TENDER_SQL}, '') AS sector FROM jp) "
    "SELECT count(*) FILTER (sector = 'Tender') AS tenders, count(*) FILTER (sector <> 'Tender') AS jobs FROM c"
)
def tender_split(spark, sf_dir):
    raw = job_postings(spark, sf_dir)
    return report.tender_split(build_postings(raw, PROFILES["greatrwandajobs"], as_of()))


# --- search -----------------------------------------------------------------

_SEARCHED = "live WHERE (regexp_matches(title, '(?i)officer|nurse') OR regexp_matches(company, '(?i)officer|nurse')) AND source = 'boardc' AND days_to_deadline <= 400"
CRITERIA = search.Criteria(text="officer|nurse", source="boardc", within_days=400)


@query(
    f"WITH {O.ACTIVE} SELECT id, title, company, sector, district, source, days_to_deadline FROM {_SEARCHED} "
    "ORDER BY scraped_at DESC, id LIMIT 9"
)
def search_page(spark, sf_dir):
    hits = search.search(active(spark, sf_dir), CRITERIA)
    return search.first_cards(hits).select(
        "id", "title", "company", "sector", "district", "source", "days_to_deadline"
    )


@query(
    f"WITH {O.ACTIVE}, h AS (SELECT * FROM {_SEARCHED}) SELECT count(*) AS total, least(count(*), 18) AS shown, "
    "greatest(count(*) - 18, 0) AS remaining FROM h"
)
def search_counts(spark, sf_dir):
    return search.result_counts(search.search(active(spark, sf_dir), CRITERIA), 18)


@query(
    f"WITH {O.ACTIVE} SELECT id, title, sector, district FROM live "
    "WHERE district IN ('Kigali', 'Huye') AND regexp_matches(sector, '(?i)IT|Health')"
)
def quick_filters(spark, sf_dir):
    c = search.Criteria(districts=("Kigali", "Huye"), sector_terms=("IT", "Health"))
    return search.search(active(spark, sf_dir), c).select("id", "title", "sector", "district")


@query(
    f"WITH {O.ACTIVE} SELECT id, title FROM live WHERE sector = 'Health' AND district = 'Musanze' AND contains(lower(company), 'org ')"
)
def exact_filters(spark, sf_dir):
    c = search.Criteria(text="org ", literal=True, sector="Health", district="Musanze")
    return search.search(active(spark, sf_dir), c).select("id", "title")


@query(
    f"WITH {O.ACTIVE}, p AS (SELECT * FROM act ORDER BY scraped_at DESC, id LIMIT 45) SELECT (SELECT count(*) FROM act) AS total, "
    f"count(*) FILTER (due IS NULL OR due >= {AS_OF_SQL}) AS shown, (SELECT greatest(count(*) - 45, 0) FROM act) AS remaining FROM p"
)
def search_reset(spark, sf_dir):
    return search.result_counts(search.search(active(spark, sf_dir), search.Criteria(reset=True)), 45)


_LEFT = f"(epoch_us(due) - epoch_us({AS_OF_SQL})) / 1000000.0"


@query(f"""WITH {O.ACTIVE}, s AS (SELECT *, {_LEFT} AS sec, days_to_deadline AS d FROM act WHERE due IS NULL OR {_LEFT} >= 0)
SELECT id, title, company, sector AS sector_label, district AS district_label, source,
 CASE WHEN trim(education_level) NOT IN ('', 'EMPTY') THEN education_level ELSE 'Not Specified' END AS education_label,
 CASE WHEN trim(experience_years) NOT IN ('', 'EMPTY') THEN experience_years || ' years' ELSE 'Not Specified' END AS experience_label,
 CASE WHEN sec IS NULL THEN 'No deadline'
  WHEN sec < 3600 THEN '🚨 ' || CAST(CAST(floor(sec / 60) AS BIGINT) AS VARCHAR) || ' minutes left!'
  WHEN sec < 86400 THEN '🚨 ' || CAST(CAST(floor(sec / 3600) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor((sec % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm left!'
  WHEN d <= 2 THEN '🚨 ' || CAST(d AS VARCHAR) || ' days ' || CAST(CAST(floor((sec % 86400) / 3600) AS BIGINT) AS VARCHAR) || 'h left!'
  WHEN d <= 7 THEN '⏰ ' || CAST(d AS VARCHAR) || ' days left' ELSE '✅ ' || CAST(d AS VARCHAR) || ' days left' END AS badge,
 CASE WHEN d IS NULL THEN 'badge-source' WHEN d <= 2 THEN 'badge-urgent' WHEN d <= 7 THEN 'badge-warning' ELSE 'badge-ok' END AS urgency,
 CASE WHEN sec IS NULL THEN 'No deadline specified' WHEN sec < 86400 THEN 'Deadline: ' || strftime(due, '%b %d, %Y %I:%M %p')
  ELSE 'Deadline: ' || strftime(due, '%b %d, %Y') END AS deadline_line, source_url FROM s""")
def job_cards(spark, sf_dir):
    return search.cards(active(spark, sf_dir))


# --- records ----------------------------------------------------------------


@query(f"""WITH {O.JOBS}, c AS (SELECT jobs.*, jp.deadline_raw FROM jobs JOIN jp USING (id)) SELECT id, title, company, description,
 {O.squeeze('location_raw')} AS location_raw, district, 'Rwanda' AS country, contains(lower(location_raw), 'remote') AS is_remote,
 contains(lower(location_raw), 'hybrid') AS is_hybrid, {O.eligibility('rwanda_eligible')} AS rwanda_eligible,
 {O.eligibility('eligibility_reason')} AS eligibility_reason, CAST({O.eligibility('confidence_score')} AS INTEGER) AS confidence_score,
 sector, job_level, experience_years, employment_type, education_level, {O.salary_min('description')} AS salary_min,
 {O.salary_max('description')} AS salary_max, {O.currency('description')} AS currency,
 {O.salary_min('description')} IS NOT NULL AS salary_disclosed, '' AS posted_date, deadline_raw AS deadline, scraped_at, source, source_url,
 '' AS source_job_id, is_active, {AS_OF_SQL} AS last_checked, md5(source_url) AS duplicate_hash FROM c""")
def classify_all(spark, sf_dir):
    return postings(spark, sf_dir)


@query(f"SELECT id, deadline_raw, {O.parse_date('deadline_raw')} AS deadline FROM (WITH {O.JP} SELECT * FROM jp)")
def parse_deadlines(spark, sf_dir):
    return job_postings(spark, sf_dir).select("id", "deadline_raw", D.parse_date("deadline_raw").alias("deadline"))


@query(f"SELECT id, {O.loose_deadline('deadline_raw')} AS deadline, {O.parse_date(O.loose_deadline('deadline_raw'))} AS loaded FROM (WITH {O.JP} SELECT * FROM jp)")
def loose_deadlines(spark, sf_dir):
    d = D.loose_deadline("deadline_raw")
    return job_postings(spark, sf_dir).select("id", d.alias("deadline"), D.parse_date(d).alias("loaded"))


@query(f"""WITH {O.JP} SELECT id, title, '' AS company, description, location_raw, '' AS district, 'Rwanda' AS country,
 false AS is_remote, false AS is_hybrid, true AS rwanda_eligible, '' AS eligibility_reason,
 coalesce(CAST(trunc(TRY_CAST(regexp_extract(description, '([0-9]+)', 1) AS DOUBLE)) AS INTEGER), 0) AS confidence_score, '' AS sector, '' AS job_level, '' AS experience_years,
 '' AS employment_type, '' AS education_level, CAST(TRY_CAST(regexp_extract(replace(description, ',', ''), '([0-9]{{4,9}})', 1) AS DOUBLE) AS DECIMAL(12,2)) AS salary_min,
 CAST(NULL AS DECIMAL(12,2)) AS salary_max, '' AS currency, false AS salary_disclosed, '' AS posted_date, deadline_raw AS deadline, scraped_at, source, source_url,
 '' AS source_job_id, is_active, CAST(NULL AS TIMESTAMP) AS last_checked, '' AS duplicate_hash FROM jp""")
def enforced_schema(spark, sf_dir):
    raw = job_postings(spark, sf_dir).withColumnsRenamed({"deadline_raw": "deadline"}).withColumns(
        {
            "confidence_score": F.regexp_extract("description", r"([0-9]+)", 1),
            "salary_min": F.regexp_extract(F.replace("description", F.lit(","), F.lit("")), r"([0-9]{4,9})", 1),
        }
    )
    return enforce(raw.drop("company").withColumn("unknown_column", F.lit(1)))


@query(f"""WITH {O.JOBS}, c AS (SELECT jobs.*, jp.deadline_raw FROM jobs JOIN jp USING (id)) SELECT id, title, company, district, sector,
 'RWF' AS currency, {O.salary_min('description')} AS salary_min, CAST(NULL AS DATE) AS posted_date, deadline, {AS_OF_SQL} AS scraped_at, true AS is_active FROM c""")
def load_batch(spark, sf_dir):
    rows = load_rows(postings(spark, sf_dir).drop("currency"), as_of())
    return rows.select(
        "id", "title", "company", "district", "sector", "currency", "salary_min", "posted_date", "deadline", "scraped_at", "is_active"
    )


@query(f"""WITH {O.JP}, s AS (SELECT source_url, title, company FROM jp WHERE contains(source_url, '/0/')),
 d AS (SELECT source_url, CASE WHEN ends_with(source_url, '3') THEN '' ELSE upper(title) END AS title, description,
   CASE WHEN contains(description, 'Remote') THEN '' ELSE location_raw END AS location_raw FROM jp WHERE NOT ends_with(source_url, '7'))
SELECT s.source_url, coalesce(nullif(d.title, ''), nullif(s.title, ''), '') AS title, coalesce(nullif(s.company, ''), '') AS company,
 coalesce(nullif(d.description, ''), '') AS description, coalesce(nullif(d.location_raw, ''), 'Rwanda') AS location_raw
FROM s LEFT JOIN d USING (source_url)""")
def merge_stub_detail(spark, sf_dir):
    jp = job_postings(spark, sf_dir)
    stubs = jp.filter(F.contains(F.col("source_url"), F.lit("/0/"))).select("source_url", "title", "company")
    details = jp.filter(~F.endswith(F.col("source_url"), F.lit("7"))).select(
        "source_url",
        F.when(F.endswith(F.col("source_url"), F.lit("3")), "").otherwise(F.upper("title")).alias("title"),
        "description",
        F.when(F.contains(F.col("description"), F.lit("Remote")), "").otherwise(F.col("location_raw")).alias("location_raw"),
    )
    rules = {
        "title": (["d_title", "title"], ""),
        "company": (["company"], ""),
        "description": (["d_description"], ""),
        "location_raw": (["d_location_raw"], "Rwanda"),
    }
    return records.merge_fields(records.attach_details(stubs, details), rules).select("source_url", *rules)


# --- ingest -----------------------------------------------------------------

_EXISTING = "existing AS (SELECT id FROM jp WHERE CAST(split_part(source_url, '/', -1) AS BIGINT) % 5 = 0)"


def existing_ids(spark, sf_dir):
    number = F.substring_index("source_url", "/", -1).cast("bigint")
    return job_postings(spark, sf_dir).filter(number % 5 == 0).select("id")


@query(f"WITH {O.JP}, {_EXISTING} SELECT id, title, company, source, source_url FROM jp WHERE id NOT IN (SELECT id FROM existing)")
def ingest_new(spark, sf_dir):
    batch = job_postings(spark, sf_dir).select("id", "title", "company", "source", "source_url")
    return ingest.new_rows(batch, existing_ids(spark, sf_dir))


_COUNTS = f"""{_EXISTING}, counts AS (SELECT source, count(*) AS found, count(*) FILTER (id NOT IN (SELECT id FROM existing)) AS new,
 CAST(0 AS BIGINT) AS updated, count(*) FILTER (id IN (SELECT id FROM existing)) AS skipped FROM jp GROUP BY source)"""


def _counts(spark, sf_dir):
    return ingest.ingest_counts(job_postings(spark, sf_dir), existing_ids(spark, sf_dir))


@query(f"WITH {O.JP}, {_COUNTS} SELECT * FROM counts")
def ingest_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"""WITH {O.JP}, {_COUNTS} SELECT source, CASE WHEN source = 'boardc' THEN 'failed' ELSE 'completed' END AS status,
 {AS_OF_SQL} AS started_at, {AS_OF_SQL} + INTERVAL 5 MINUTE AS completed_at, found AS jobs_found, CASE WHEN source = 'boardc' THEN 0 ELSE new END AS jobs_new,
 CAST(0 AS BIGINT) AS jobs_updated, CASE WHEN source = 'boardc' THEN 'timeout' END AS error_message FROM counts""")
def run_log(spark, sf_dir):
    error = F.when(F.col("source") == "boardc", "timeout")
    done = as_of() + F.expr("INTERVAL 5 MINUTES")
    return ingest.run_log(_counts(spark, sf_dir), as_of(), done, error).drop("run_id")


@query(f"""WITH {O.JP}, {_COUNTS}, names AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS total FROM nation
  UNION ALL SELECT DISTINCT source, CAST(100 AS BIGINT) FROM jp WHERE source <> 'boardd')
SELECT name, CASE WHEN new IS NOT NULL THEN {AS_OF_SQL} ELSE TIMESTAMP '2026-01-01 00:00:00' END AS last_scraped,
 total + coalesce(new, 0) AS total_jobs_scraped FROM names LEFT JOIN counts ON name = source""")
def source_stats(spark, sf_dir):
    before = F.lit("2026-01-01 00:00:00").cast("timestamp").alias("last_scraped")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), before, F.col("n_nationkey").cast("bigint").alias("total_jobs_scraped")
    )
    boards = (
        job_postings(spark, sf_dir).filter("source <> 'boardd'").select(F.col("source").alias("name")).distinct()
        .select("name", before, F.lit(100).cast("bigint").alias("total_jobs_scraped"))
    )
    return ingest.update_source_stats(nations.unionByName(boards), _counts(spark, sf_dir), as_of())


@query("SELECT event_id AS run_id, event_type AS source, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, "
       "CAST(value AS BIGINT) AS jobs_new, ts + INTERVAL 5 MINUTE AS completed_at FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("ts").alias("started_at"),
        F.round("value").cast("bigint").alias("jobs_new"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("completed_at"),
    )
    return report.recent_runs(runs)


@query(f"WITH {O.JP}, {_EXISTING} SELECT source, count(*) AS jobs FROM jp WHERE id NOT IN (SELECT id FROM existing) GROUP BY source")
def delete_ids(spark, sf_dir):
    kept = ingest.delete_ids(job_postings(spark, sf_dir), existing_ids(spark, sf_dir))
    return kept.groupBy("source").agg(F.count("*").alias("jobs"))


# --- distinct ---------------------------------------------------------------


@query(f"SELECT md5(k) AS duplicate_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {O.title_key('text')} AS k FROM documents) GROUP BY k")
def distinct_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    keyed = docs.select("doc_id", T.identity(T.title_key("text")).alias("duplicate_hash"))
    return keyed.groupBy("duplicate_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH d AS (SELECT doc_id, md5(text) AS duplicate_hash, lang, source FROM documents)
SELECT doc_id, duplicate_hash, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY duplicate_hash ORDER BY doc_id) AS r FROM d) WHERE r = 1""")
def first_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", T.identity("text").alias("duplicate_hash"), "lang", "source", F.lit("").alias("source_url")
    )
    return records.first_by_hash(docs, [F.col("doc_id")]).drop("source_url")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS source_url, html FROM pages)
SELECT source_url, page_id, length(html) AS size FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY page_id) AS r FROM p) WHERE r = 1 AND source_url <> ''""")
def first_per_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        "page_id", T.host_of("url").alias("source_url"), F.length("html").cast("bigint").alias("size")
    )
    return records.first_per_key(p, ["source_url"], [F.col("page_id")])


# --- duplicates -------------------------------------------------------------


@query(f"SELECT id, {O.title_key('title')} AS title_key, {O.company_key('company')} AS company_key, {O.company_base('company')} AS company_base FROM (WITH {O.JP} SELECT * FROM jp)")
def duplicate_keys(spark, sf_dir):
    return job_postings(spark, sf_dir).select(
        "id",
        T.title_key("title").alias("title_key"),
        T.company_key("company").alias("company_key"),
        T.company_base("company").alias("company_base"),
    )


@query(f"SELECT id, regexp_extract(regexp_replace({O.strip("regexp_replace(" + O.strip("lower(deadline_raw)") + ", '^on ', '')")}, '[/.]', '-', 'g'), '^(\\S+)', 1) AS deadline_key FROM (WITH {O.JP} SELECT * FROM jp)")
def deadline_keys(spark, sf_dir):
    return job_postings(spark, sf_dir).select("id", T.deadline_key("deadline_raw").alias("deadline_key"))


@query(f"""WITH {O.JP}, k AS (SELECT {O.company_key('company')} AS company_key, company FROM jp)
SELECT company_key, count(DISTINCT company) AS spellings, count(*) AS jobs FROM k WHERE company_key <> '' GROUP BY 1 HAVING count(DISTINCT company) > 1""")
def company_variants(spark, sf_dir):
    return dedup.company_variants(job_postings(spark, sf_dir))


def _dedup_input(spark, sf_dir):
    jp = job_postings(spark, sf_dir).withColumn("deadline", D.parse_date("deadline_raw"))
    return search.dedup_scan(jp)


@query(f"""WITH {O.JP}, k AS (SELECT id, {O.title_key('title')} AS t, {O.company_key('company')} AS n, {O.parse_date('deadline_raw')} AS d, scraped_at FROM jp WHERE is_active),
 r AS (SELECT 'company' AS rule, t, n AS v, count(*) AS c FROM k WHERE n <> '' GROUP BY ALL
  UNION ALL SELECT 'deadline', t, CAST(d AS VARCHAR), count(*) FROM k WHERE d IS NOT NULL GROUP BY ALL)
SELECT rule, t AS title_key, v AS shared_value, c AS copies FROM r WHERE c > 1""")
def exact_duplicate_units(spark, sf_dir):
    keyed = dedup.with_duplicate_keys(_dedup_input(spark, sf_dir))
    return dedup.exact_units(keyed)


@query(None)
def duplicate_leaders(spark, sf_dir):
    return dedup.duplicate_leaders(_dedup_input(spark, sf_dir))


@query(None)
def duplicate_groups(spark, sf_dir):
    scan = _dedup_input(spark, sf_dir)
    return dedup.group_report(scan, dedup.duplicate_leaders(scan))


@query(None)
def pipeline_totals(spark, sf_dir):
    scan = _dedup_input(spark, sf_dir)
    removed = dedup.duplicate_leaders(scan)
    return report.pipeline_totals(_counts(spark, sf_dir), removed, dedup.survivors(scan, removed))


# --- classifiers on text ----------------------------------------------------

_DOC_WORDS = {"Licence": ["license", "copyright"], "Middle": ["mid", "the "], "Short": ["de ", "la"], "Other": ["ing", "er", "und "]}


@query(f"SELECT doc_id, {O.keyword('text', _DOC_WORDS)} AS plain, {O.keyword('text', _DOC_WORDS, mode='boundary_raw')} AS raw, "
       f"{O.keyword('text', _DOC_WORDS, mode='boundary_stripped')} AS stripped FROM documents")
def document_categories(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        C.keyword_category("text", _DOC_WORDS).alias("plain"),
        C.keyword_category("text", _DOC_WORDS, mode=C.BOUNDARY_RAW).alias("raw"),
        C.keyword_category("text", _DOC_WORDS, mode=C.BOUNDARY_STRIPPED).alias("stripped"),
    )


@query(f"SELECT id, coalesce({O.keyword('description', vocab.SECTOR, 'title', 'boundary_stripped')}, '') AS sector, "
       f"coalesce({O.keyword('description', vocab.LEVEL, 'title', 'boundary_raw')}, '') AS job_level, "
       f"coalesce({O.keyword('description', vocab.EDUCATION_A2_MASTER, None, 'boundary_stripped')}, '') AS education_level FROM (WITH {O.JP} SELECT * FROM jp)")
def bounded_keywords(spark, sf_dir):
    return job_postings(spark, sf_dir).select(
        "id",
        F.coalesce(C.keyword_category("description", vocab.SECTOR, "title", C.BOUNDARY_STRIPPED), F.lit("")).alias("sector"),
        F.coalesce(C.keyword_category("description", vocab.LEVEL, "title", C.BOUNDARY_RAW), F.lit("")).alias("job_level"),
        F.coalesce(C.keyword_category("description", vocab.EDUCATION_A2_MASTER, None, C.BOUNDARY_STRIPPED), F.lit("")).alias("education_level"),
    )


_FIRST = "CASE " + " ".join(f"WHEN contains(lower(title), {O.q(k)}) THEN {O.q(v)}" for k, v in vocab.SECTOR_FIRST_MATCH.items()) + " ELSE 'Other' END"


def _words(x, words):
    return "(" + " OR ".join(f"contains({x}, {O.q(w)})" for w in words) + ")"


@query(f"""SELECT id, {_FIRST} AS sector, CASE WHEN {_words('lower(title)', vocab.TITLE_SENIOR_WORDS)} THEN 'Senior'
  WHEN {_words('lower(title)', vocab.TITLE_JUNIOR_WORDS)} THEN 'Junior' ELSE 'Mid-Level' END AS job_level,
 CASE WHEN {_words('lower(description)', ['full-time', 'full time'])} THEN 'Full-time' WHEN {_words('lower(description)', ['part-time', 'part time'])} THEN 'Part-time'
  WHEN contains(lower(description), 'temporary') THEN 'Temporary' WHEN contains(lower(description), 'freelance') THEN 'Freelance'
  WHEN contains(lower(description), 'internship') THEN 'Internship' WHEN {_words('lower(description)', ['contract', 'consultancy'])} THEN 'Contract' ELSE 'Full-time' END AS employment_type,
 CASE {' '.join(f"WHEN contains(lower(location_raw), {O.q(d.lower())}) THEN {O.q(d)}" for d in vocab.DISTRICTS_TOWNS)} WHEN lower(location_raw) = 'rwanda' THEN '' ELSE location_raw END AS district
FROM (WITH {O.JP} SELECT * FROM jp)""")
def rule_classifiers(spark, sf_dir):
    return job_postings(spark, sf_dir).select(
        "id",
        C.first_match_sector(F.lit(""), "title").alias("sector"),
        C.level_from_title("title").alias("job_level"),
        C.employment_from_label("description").alias("employment_type"),
        X.named_district("location_raw")["district"].alias("district"),
    )


_RAWCARD = "title || ', ' || CASE WHEN ends_with(id, 'a') THEN 'P4' WHEN ends_with(id, 'b') THEN 'NO-2' WHEN ends_with(id, 'c') THEN 'd1' ELSE 'Fixed-Term' END || ', Kigali, Rwanda, #00' || split_part(source_url, '/', -1)"
_GRADE = r"upper(regexp_extract(raw, '(?i)\b(P[1-6]|G[1-7]|D[12]|NO-?[A-D1-4]|ASG|USG|FS-\d)\b', 1))"


@query(f"""WITH {O.JP}, c AS (SELECT id, title, {_RAWCARD} AS raw FROM jp), g AS (SELECT *, {_GRADE} AS grade FROM c)
SELECT id, grade, CASE WHEN regexp_matches(grade, '^(P[12]|G[1-5]|NO-?[AB12])$') THEN 'Entry' WHEN regexp_matches(grade, '^(P3|NO-?[CD34])$') THEN 'Mid'
 WHEN regexp_matches(grade, '^P[456]$') THEN 'Senior' WHEN regexp_matches(grade, '^(D[12]|ASG|USG)$') THEN 'Executive' ELSE '' END AS job_level,
 CASE WHEN {_words('lower(raw)', ['individual contractor', 'consultancy', 'consultant', 'freelance'])} THEN 'Consultancy' WHEN {_words('lower(raw)', ['volunteer', 'unv', 'voluntary'])} THEN 'Volunteer'
 WHEN {_words('lower(raw)', ['intern', 'attachment', 'apprentice'])} THEN 'Internship' WHEN {_words('lower(raw)', ['part-time', 'part time'])} THEN 'Part-time'
 WHEN {_words('lower(raw)', ['permanent', 'indefinite', 'full-time', 'full time'])} THEN 'Full-time' ELSE 'Contract' END AS employment_type,
 {O.squeeze('title')} AS title FROM g""")
def un_cards(spark, sf_dir):
    tail = F.expr("CASE WHEN endswith(id, 'a') THEN 'P4' WHEN endswith(id, 'b') THEN 'NO-2' WHEN endswith(id, 'c') THEN 'd1' ELSE 'Fixed-Term' END")
    raw = F.concat("title", F.lit(", "), tail, F.lit(", Kigali, Rwanda, #00"), F.substring_index("source_url", "/", -1))
    df = job_postings(spark, sf_dir).select("id", raw.alias("raw")).withColumn("grade", C.un_grade("raw"))
    return df.select(
        "id", "grade", C.un_grade_level("grade").alias("job_level"), C.un_employment("raw").alias("employment_type"),
        T.bare_title("raw", F.lit(""), "grade").alias("title"),
    )


@query(f"SELECT id, {O.experience('description')} AS experience_years, {O.salary_min('description')} AS salary_min, {O.salary_max('description')} AS salary_max, "
       f"{O.currency('description')} AS currency FROM (WITH {O.JP} SELECT * FROM jp)")
def experience_and_salary(spark, sf_dir):
    pay = X.salary("description")
    return job_postings(spark, sf_dir).select(
        "id", X.experience_years("description").alias("experience_years"), pay["salary_min"].alias("salary_min"),
        pay["salary_max"].alias("salary_max"), pay["currency"].alias("currency"),
    )


@query(f"SELECT doc_id, {O.experience('text')} AS experience_years, regexp_extract(text, '(?i)license|pay', 0) AS first_word, "
       "CASE WHEN regexp_matches(text, '(?i)license|pay') THEN substr(text, greatest(length(regexp_extract(text, '(?is)^(.*?)(?:license|pay)', 1)) + 1 - 30, 1), "
       "length(regexp_extract(text, '(?is)^(.*?)(?:license|pay)', 1)) + 1 + length(regexp_extract(text, '(?i)license|pay', 0)) + 80 - greatest(length(regexp_extract(text, '(?is)^(.*?)(?:license|pay)', 1)) + 1 - 30, 1)) END AS snippet FROM documents")
def document_facts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        X.experience_years("text").alias("experience_years"),
        F.regexp_extract("text", "(?i)license|pay", 0).alias("first_word"),
        X.around_first("text", "license|pay", 30, 80).alias("snippet"),
    )


@query(f"""SELECT id, CASE WHEN contains(v, '3 to') THEN '' ELSE v END AS pay_clause, place, role FROM (
 SELECT id, {O.strip("regexp_extract(description, '(?i)(?:Salary|Pay):? (.+?)\\.', 1)")} AS v, {O.strip("regexp_extract(description, '(?i)\\bStation\\s*:\\s*(.+?)(?:\\n|$)', 1)")} AS place,
 {O.strip("regexp_extract(description, '^(.*?) wanted', 1)")} AS role FROM (WITH {O.JP} SELECT * FROM jp))""")
def labelled_fields(spark, sf_dir):
    v = F.coalesce(T.capture("description", r"(?:Salary|Pay):? (.+?)\."), F.lit(""))
    return job_postings(spark, sf_dir).select(
        "id",
        F.when(F.contains(v, F.lit("3 to")), "").otherwise(v).alias("pay_clause"),
        F.coalesce(X.labelled("description", "Station", ()), F.lit("")).alias("place"),
        F.coalesce(T.capture("description", "^(.*?) wanted"), F.lit("")).alias("role"),
    )


_SAID = "replace(description, 'Station:', CASE WHEN ends_with(id, '1') THEN 'Deadline: ' WHEN ends_with(id, '2') THEN 'Apply before ' WHEN ends_with(id, '3') THEN 'Closing date: ' ELSE 'Open until ' END || deadline_raw || ' Station:')"


@query(f"""WITH {O.JP}, s AS (SELECT id, {_SAID} AS said FROM jp)
SELECT id, coalesce(
 nullif(regexp_extract(said, '(?i)deadline[:\\s]+(\\d{{1,2}}\\s+(?:{O._MON})[a-z]*\\s+\\d{{4}})', 1), ''),
 nullif(regexp_extract(said, '(?i)(?:closing|due)\\s+date[:\\s]+(\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{4}})', 1), ''),
 nullif(regexp_extract(said, '(?i)apply\\s+(?:before|by)[:\\s]+(\\d{{1,2}}\\s+(?:{O._MON})[a-z]*\\s+\\d{{4}})', 1), ''),
 nullif(regexp_extract(said, '(?i)deadline[:\\s]+(\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}})', 1), ''),
 CASE WHEN regexp_matches(said, '(?i)deadline[:\\s]*(?:ongoing|continuous|rolling|open)') THEN 'Ongoing' ELSE '' END) AS deadline FROM s""")
def stated_deadlines(spark, sf_dir):
    said = F.expr(_SAID.replace("ends_with", "endswith"))
    return job_postings(spark, sf_dir).select("id", X.stated_deadline(said).alias("deadline"))


_HEAD = "CASE WHEN ends_with(id, '1') THEN '10 Job Positions' WHEN ends_with(id, '2') THEN '5 Positions of ' || title ELSE title END || ' at ' || company || ': (Deadline ' || deadline_raw || ')'"


@query(f"""WITH {O.JP} SELECT id, CASE WHEN ends_with(id, '1') THEN '10 Positions at ' || {O.squeeze('company')} ELSE {O.squeeze('title')} END AS title,
 {O.squeeze('company')} AS company, deadline_raw AS deadline, CASE WHEN ends_with(id, '1') THEN '10' WHEN ends_with(id, '2') THEN '5' ELSE '' END AS positions_count FROM jp""")
def announcement_titles(spark, sf_dir):
    head = F.expr(_HEAD.replace("ends_with", "endswith"))
    df = job_postings(spark, sf_dir).select("id", T.announcement_title(head).alias("a"))
    return df.select("id", "a.title", "a.company", "a.deadline", "a.positions_count")


_AGE = "['Posted 5 hours ago', 'Posted 3 days ago', 'Posted 2 weeks ago', 'Posted 2 months ago', 'Posted 1 year ago', 'just now']"


@query(f"""WITH {O.JP}, k AS (SELECT id, CAST(split_part(source_url, '/', -1) AS BIGINT) AS k FROM jp)
SELECT id, CASE k % 6 WHEN 0 THEN 'on 01-03-2026' WHEN 1 THEN 'on ' || strftime(DATE '2026-03-01' - CAST(k % 40 AS INTEGER), '%d-%m-%Y')
 WHEN 2 THEN 'on ' || strftime(DATE '2026-03-01' - CAST(7 * (k % 40) AS INTEGER), '%d-%m-%Y')
 WHEN 3 THEN 'on ' || strftime(DATE '2026-03-01' - to_months(CAST(k % 40 AS INTEGER)), '%d-%m-%Y')
 WHEN 4 THEN 'on ' || strftime(DATE '2026-03-01' - to_years(CAST(k % 40 AS INTEGER)), '%d-%m-%Y') ELSE '' END AS posted_date,
 CASE WHEN k % 6 = 1 THEN strftime(DATE '2026-03-01' - CAST(k % 40 AS INTEGER), '%Y-%m-%d') WHEN k % 6 = 5 THEN 'just now'
  ELSE 'Posted ' || CAST(k % 40 AS VARCHAR) || CASE k % 6 WHEN 0 THEN ' hours ago' WHEN 2 THEN ' weeks ago' WHEN 3 THEN ' months ago' ELSE ' years ago' END END AS day FROM k""")
def relative_dates(spark, sf_dir):
    k = F.substring_index("source_url", "/", -1).cast("bigint")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("hours", "days", "weeks", "months", "years", "")]), (k % 6 + 1).cast("int"))
    age = F.when(k % 6 == 5, "just now").otherwise(F.concat(F.lit("Posted "), (k % 40).cast("string"), F.lit(" "), unit, F.lit(" ago")))
    return job_postings(spark, sf_dir).select(
        "id", D.relative_day(age, as_of()).alias("posted_date"), D.days_ago(age, as_of()).alias("day")
    )


_D = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, 'on ' || strftime({_D}, '%d-%m-%Y') AS slashed, strftime({_D}, '%Y-%m-%d') AS us, strftime({_D}, '%Y-%m-%d') AS named, "
       f"'on ' || strftime({_D}, '%d-%m-%Y') AS feed, strftime({_D}, '%Y-%m-%d') AS posted, year({_D}) BETWEEN 1993 AND 1997 AS valid FROM orders")
def date_formats(spark, sf_dir):
    d = F.col("o_orderdate")

    def as_text(f: str):
        return F.date_format(d, f)

    card = F.concat(F.lit("Role at X | Published on "), as_text("d-M-yyyy"), F.lit(" | Deadline 1-1-2026"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(
        "o_orderkey",
        D.slashed_day(as_text("d/M/yyyy 17:00")).alias("slashed"),
        D.abbreviated_us(F.concat(F.lit("Posted "), as_text("MMM d, yyyy"))).alias("us"),
        D.slashed_month_name(as_text("d/MMM/yyyy")).alias("named"),
        D.feed_day(F.concat(as_text("E"), F.lit(", "), as_text("dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))).alias("feed"),
        D.published_and_deadline(card)["posted_date"].alias("posted"),
        D.valid_date(as_text("yyyy-MM-dd"), (1993, 1997)).alias("valid"),
    )


# --- pages ------------------------------------------------------------------

_HREF = O.q(H.LINK)


def _sql_unescape(x):
    for entity, char in H._ENTITIES:
        x = f"replace({x}, {O.q(entity)}, {O.q(char)})"
    return x


def _sql_text(x):
    return O.squeeze(_sql_unescape(f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"))


def _sql_drop(x):
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in H.BOILERPLATE:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return x


_ALINKS = f"""l AS (SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(t) AS txt
 FROM (SELECT url, regexp_extract_all(html, {_HREF}, 1) AS h, regexp_extract_all(html, {_HREF}, 2) AS t FROM pages)),
 r AS (SELECT url, host, pos, {_sql_unescape('href')} AS href, {_sql_text('txt')} AS text FROM l),
 a AS (SELECT url, pos, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN split_part(host, '//', 1) || href
  WHEN starts_with(href, '/') THEN host || href ELSE host || '/' || href END AS source_url, text FROM r)"""


@query(f"WITH {_ALINKS} SELECT url, CAST(pos AS INTEGER) AS pos, source_url, text FROM (SELECT *, row_number() OVER (PARTITION BY url, source_url ORDER BY pos) AS n FROM a) WHERE n = 1")
def page_links(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("url", "html"))
    return pages.page_links(p, T.host_of("url")).select("url", "pos", "source_url", "text")


@query(f"SELECT page_id, {_sql_text(_sql_drop('html'))} AS text FROM pages")
def page_text(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return p.select("page_id", H.visible_text("html").alias("text"))


_ART = "regexp_extract(html, '(?is)<(?:article)\\b[^>]*>(.*?)</(?:article)\\s*>', 1)"
_H1 = "regexp_extract(html, '(?is)<(?:h1)\\b[^>]*>(.*?)</(?:h1)\\s*>', 1)"


@query(f"SELECT page_id, nullif({_sql_text(_H1)}, '') AS title, nullif({_sql_text(_ART)}, '') AS description, "
       "coalesce(nullif(regexp_extract(html, '(?is)<(?:html)\\b[^>]*?\\blang\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), ''), '') AS lang FROM pages")
def page_details(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return p.select(
        "page_id",
        H.element_text("html", "h1").alias("title"),
        H.element_text("html", "article").alias("description"),
        F.coalesce(H.attribute("html", "html", "lang"), F.lit("")).alias("lang"),
    )


_CARD = r"(?is)<p\b[^>]*>.*?</p\s*>"
_CARD_BOARD = SourceProfile(
    "paragraphs", "https://example.org", "", card=_CARD,
    stub=lambda card, url: {"source_url": url, "title": H.text_of(card), "is_bold": F.contains(card, F.lit("<b>"))},
)


@query(f"""WITH c AS (SELECT url, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS card FROM (SELECT url, regexp_extract_all(html, {O.q(_CARD)}, 0) AS p FROM pages))
SELECT url, CAST(pos AS INTEGER) AS pos, url AS source_url, {_sql_text('card')} AS title, contains(card, '<b>') AS is_bold, 'paragraphs' AS source FROM c WHERE {_sql_text('card')} <> ''""")
def page_cards(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("url", "html"))
    return pages.extract_cards(p, _CARD_BOARD)


_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1)"


@query(rf"""SELECT page_id, {_PATH} AS path, split_part(regexp_replace({_PATH}, '/+$', ''), '/', -1) AS slug,
 regexp_extract(regexp_replace({_PATH}, '/+$', ''), '-(\d+)$', 1) AS trailing_id, coalesce(regexp_extract(url, 'page=([^&]+)', 1), '') AS page,
 regexp_matches({_PATH}, '[^/]') AND NOT regexp_matches(lower({_PATH}), '/page/|/category/|/tag/|/wp-|/feed|/scholarships/|/tenders/|/tender-') AND starts_with(url, 'https://') AS is_posting FROM pages""")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.url_path("url").alias("path"),
        T.slug("url").alias("slug"),
        T.trailing_id("url").alias("trailing_id"),
        F.coalesce(T.query_value("url", "page"), F.lit("")).alias("page"),
        pages.real_posting("url", "https://").alias("is_posting"),
    )


@query(r"""WITH n AS (SELECT url, list_max(CAST(regexp_extract_all(html, '[/=](\d{1,3})["&]', 1) AS INTEGER[])) AS last FROM (SELECT url, url || '"' AS html FROM pages)),
 e AS (SELECT url, CAST(unnest(range(0, coalesce(last, 0) + 1)) AS INTEGER) AS page FROM n)
SELECT url, page, CASE WHEN page = 0 THEN url ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || CAST(page AS VARCHAR) END AS page_url FROM e""")
def pager_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.concat("url", F.lit('"')).alias("html"))
    return pages.expand_pager(p, r'[/=](\d{1,3})["&]')


@query(f"""WITH {_ALINKS}, k AS (SELECT DISTINCT url, source_url FROM a WHERE starts_with(source_url, 'http')) SELECT source_url FROM k
 WHERE NOT regexp_matches(lower(source_url), '/the') GROUP BY source_url""")
def url_union(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("url", "html"))
    links = pages.page_links(p, T.host_of("url"))
    return records.url_set(links, links.select("source_url")).filter(~F.lower("source_url").rlike("/the"))


# --- feeds, tiers, splitting ------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS found_jobs, event_type AS html FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 0")
def event_envelopes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.substring_index("props", "}", 1), F.lit(', "html": "'), F.col("event_type"), F.lit('"}')).alias("payload")
    )
    k = e.withColumn("payload", F.regexp_replace("payload", '"k"', '"found_jobs"'))
    return json_envelope(k, "payload", keep=("event_id",), found_type="int")


@query(f"""WITH {O.JP} SELECT source_url, {O.squeeze('title')} AS title, split_part(source_url, '/', -1) AS source_job_id,
 'on ' || strftime(scraped_at, '%d-%m-%Y') AS posted_date FROM jp""")
def rss_items(spark, sf_dir):
    jp = job_postings(spark, sf_dir)
    stamp = F.concat(F.date_format("scraped_at", "E"), F.lit(", "), F.date_format("scraped_at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    xml = F.concat(
        F.lit("<item><title>"), F.col("title"), F.lit("</title><link>"), F.col("source_url"),
        F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>"),
    )
    return rss_stubs(jp.select(xml.alias("xml")), "xml").select("source_url", "title", "source_job_id", "posted_date")


@query("""WITH t AS (SELECT doc_id, source, lang, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS tier FROM documents)
SELECT doc_id, source, lang, tier FROM t JOIN (SELECT source, min(tier) AS best FROM t GROUP BY source) USING (source) WHERE tier = best""")
def first_filled_tier(spark, sf_dir):
    tier = F.expr("CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END").alias("tier")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", tier)
    return first_tier(docs, ["source"])


_LISTING = "title || chr(10) || company || ' (ABC)' || chr(10) || 'APPLY' || chr(10) || 'Level:3' || chr(10) || 'Posts:2' || chr(10) || 'Under Contract' || chr(10) || 'Posted on' || chr(10) || strftime(scraped_at, '%b %d, %Y') || chr(10) || 'Deadline' || chr(10) || 'Mar 14, 2026'"


@query(f"""WITH {O.JP} SELECT id, trim(title) AS title, company || ' (ABC)' AS company, 'Level:3 Posts:2' AS source_job_id, 'Contract' AS employment_raw,
 strftime(scraped_at, '%Y-%m-%d') AS posted_date, '2026-03-14' AS deadline FROM jp""")
def plain_listing(spark, sf_dir):
    jp = job_postings(spark, sf_dir)
    day = F.date_format("scraped_at", "MMM dd, yyyy")
    lines = [F.col("title"), F.concat("company", F.lit(" (ABC)")), F.lit("APPLY"), F.lit("Level:3"), F.lit("Posts:2"),
             F.lit("Under Contract"), F.lit("Posted on"), day, F.lit("Deadline"), F.lit("Mar 14, 2026")]
    rows = pages.plain_listing(jp.select("id", F.concat_ws("\n", *lines).alias("text")), keep=("id",))
    return rows.select(
        "id", "title", "company", F.concat_ws(" ", "level", "posts").alias("source_job_id"),
        F.when(F.contains(F.col("contract"), F.lit("Contract")), "Contract").otherwise("Permanent").alias("employment_raw"),
        D.abbreviated_us("posted").alias("posted_date"), D.abbreviated_us("deadline").alias("deadline"),
    )


@query(f"""WITH {O.JP}, j AS (SELECT *, CAST(split_part(source_url, '/', -1) AS BIGINT) AS k FROM jp),
 p AS (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN ['Senior Accountant ' || k, 'Staff Nurse ' || k, 'Truck Driver ' || k] ELSE [NULL] END) AS pos FROM j)
SELECT CASE WHEN pos IS NULL THEN id ELSE md5(source_url || '_' || pos) END AS id, coalesce(pos, title) AS title,
 CASE WHEN pos IS NULL THEN md5(source_url) ELSE md5(pos || '_' || company) END AS duplicate_hash, CASE WHEN pos IS NOT NULL THEN CASE WHEN k % 3 = 0 THEN 'numbered' ELSE 'newline' END END AS extraction_method,
 pos IS NOT NULL AS is_multi_position_split FROM p""")
def split_announcements(spark, sf_dir):
    jp = job_postings(spark, sf_dir).withColumn("k", F.substring_index("source_url", "/", -1).cast("bigint"))
    names = ["Senior Accountant ", "Staff Nurse ", "Truck Driver "]
    numbered = F.concat_ws("\n", F.lit("We are hiring for"), *[F.concat(F.lit(f"{i + 1}. {n}"), "k") for i, n in enumerate(names)])
    lines = F.concat_ws("\n", F.lit("We are hiring for"), *[F.concat(F.lit(n), "k") for n in names], F.lit(""), F.lit("Details on request"))
    posts = jp.select(
        "id", "source_url", "company",
        F.when(F.col("k") % 2 == 0, "Several positions").otherwise(F.col("title")).alias("title"),
        F.when(F.col("k") % 3 == 0, numbered).otherwise(lines).alias("description"),
        T.identity("source_url").alias("duplicate_hash"),
    )
    return positions.split_positions(posts).select("id", "title", "duplicate_hash", "extraction_method", "is_multi_position_split")


@query(f"SELECT id, {_words('lower(title)', vocab.TITLE_JOB_WORDS)} AND length(title) >= 5 AND NOT {_words('lower(title)', vocab.TITLE_SKIP_WORDS)} AS valid, "
       "regexp_matches(lower(description), 'multiple|several|various') AS multi FROM (WITH " + O.JP + " SELECT * FROM jp)")
def title_tests(spark, sf_dir):
    return job_postings(spark, sf_dir).select(
        "id", positions.valid_title("title").alias("valid"), positions.is_multi_position("description").alias("multi")
    )


@query(None)
def all_boards(spark, sf_dir):
    """Every board's recipe over the same raw postings, summed per board."""
    raw = job_postings(spark, sf_dir).withColumnsRenamed({"deadline_raw": "deadline"}).withColumn("salary_text", F.col("description"))
    # ten boards read the raw postings: they are derived, and place and pay read, once
    known = written(with_facts(raw, PROFILES.values()), "raw-postings")
    built, _ = records.union_sources(
        {n: (lambda p=p: build_postings(known, p, as_of())) for n, p in PROFILES.items()},
        enforce(known.limit(0)),
    )
    summary = written(report.run_summary(built), "board-summary")
    dropped(known)
    return summary


def queries() -> dict[str, Query]:
    return {name: r.run for name, r in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: r.sql for name, r in REGISTRY.items() if r.sql}
