"""Registered queries of transform, validation and load, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laborlens.operators import dims as D
from laborlens.operators import enrich as E
from laborlens.operators import load as LO
from laborlens.operators import quality as Q
from laborlens.operators import transform as TR
from laborlens.plans.views import AS_OF, BATCH, DRAFTS, JOBS, RUNS, Views
from laborlens.session import shared_dir
from laborlens.sources import snapshots
from laborlens.streaming import ingest

WITH = "WITH " + JOBS
T = f"TIMESTAMP '{AS_OF}'"
RAW = "SELECT * FROM jobs WHERE salary_min IS NOT NULL"
COMPANY = "CASE WHEN id % 3 = 2 THEN 'Unknown' ELSE company_name END"
KIND = "CASE employment_type WHEN '1-URGENT' THEN 'FULL_TIME' WHEN '2-HIGH' THEN 'PART_TIME' WHEN '3-MEDIUM' THEN 'CONTRACT' WHEN '5-LOW' THEN 'INTERNSHIP' ELSE 'PERMANENT' END"
PAID = "CASE WHEN id % 4 <> 3 THEN CAST({0} AS DOUBLE) END"
CURRENCY = "CASE id % 4 WHEN 0 THEN 'EUR' WHEN 3 THEN NULL ELSE 'GBP' END"
DAY = "CASE id % 10 WHEN 0 THEN NULL WHEN 2 THEN strftime(posted_date, '%Y-%m-%d 00:00:00') WHEN 5 THEN strftime(posted_date, '%Y-%m-%d 00:00:00') WHEN 3 THEN strftime(posted_date - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN strftime(posted_date + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:00') ELSE strftime(posted_date, '%Y-%m-%d %H:%M:%S') END"


def _done(v: Views):
    return TR.transform(v.raw, "feed", AS_OF)


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _money(df, *names: str):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _pairs(v: Views):
    """Incoming (job_id, name) pairs: some names differ by case and blanks, some are blank."""
    held = v.links.join(v.skills, "skill_id")
    odd = held.select("job_id", F.when(F.col("skill_id") % 10 == 0, "  ").when(F.col("skill_id") % 3 == 0, F.concat(F.lit(" "), F.upper("name"))).otherwise(F.concat("name", F.lit(" x"))).alias("name"))
    return held.select("job_id", "name").unionByName(odd)


PAIRS = """
held AS (SELECT job_id, skill_id, name FROM links JOIN skills USING (skill_id)),
pairs AS (SELECT job_id, name FROM held UNION ALL SELECT job_id, CASE WHEN skill_id % 10 = 0 THEN '  ' WHEN skill_id % 3 = 0 THEN ' ' || upper(name) ELSE name || ' x' END FROM held),
clean AS (SELECT DISTINCT job_id, trim(lower(name)) AS name FROM pairs WHERE trim(name) <> '')
"""
SHOWN = "id, source_site, source_id, title, description, company_name, location, salary_currency, source_url, employment_type, language, is_tech_role, technology_category, country_code"
MERGED = f"""{WITH}, {BATCH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_site, source_id ORDER BY arrival DESC) AS k FROM incoming),
new AS (SELECT r.* EXCLUDE (k, arrival) REPLACE (coalesce(r.description, '') AS description, coalesce(r.source_url, '') AS source_url, coalesce(r.company_name, 'Unknown') AS company_name, coalesce(e.id, r.id) AS id, CASE WHEN e.id IS NULL THEN r.language ELSE e.language END AS language)
  FROM ranked r LEFT JOIN existing e ON e.source_site = r.source_site AND e.source_id = r.source_id WHERE k = 1),
up AS (SELECT {SHOWN}, CAST(salary_min AS DOUBLE) AS salary_min, CAST(salary_max AS DOUBLE) AS salary_max, strftime(posted_date, '%Y-%m-%d') AS posted, '{AS_OF}' AS scraped, true AS is_active, false AS is_deleted FROM new
UNION ALL SELECT {SHOWN}, CAST(salary_min AS DOUBLE), CAST(salary_max AS DOUBLE), strftime(posted_date, '%Y-%m-%d'), strftime(scraped_date, '%Y-%m-%d'), is_active, is_deleted FROM existing e WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.source_site = e.source_site AND n.source_id = e.source_id))"""


def _shown(out):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _money(out, "salary_min", "salary_max").select(*SHOWN.split(", "), "salary_min", "salary_max", day("posted_date").alias("posted"), day("scraped_date").alias("scraped"), "is_active", "is_deleted")


def _stamped(v: Views):
    return v.existing.withColumns({n: F.col(n).cast(t) for n, t in LO.STAMPS})


def _snapshot(v: Views):
    """The upsert by way of a table in snapshots; the batch once more changes nothing."""
    path = f"{shared_dir(v.spark)}/jobs-{uuid.uuid4().hex}"
    schema = LO.posting_schema(v.incoming.drop("arrival"))
    snapshots.create(v.spark, path, _stamped(v).select(*schema.names))
    for _ in range(2):
        snapshots.merge(v.spark, path, v.incoming, AS_OF, batch=1)
    snapshots.vacuum(v.spark, path, keep=1)
    return _shown(snapshots.latest(v.spark, path, schema))


#: Skills that titles of the test records hold; a record with more than two can't be enriched.
TRADES = ["economy", "promo", "standard", "copper", "brass", "steel", "tin", "nickel", "polished", "again"]
HELD = "list_filter([" + ", ".join(f"'{t}'" for t in TRADES) + "], lambda t: list_contains(string_split(lower(title), ' '), t))"


def _known(v: Views) -> ingest.Dictionaries:
    s = v.spark
    profile = E.language_profile(v.posts)
    return ingest.Dictionaries(profile, s.createDataFrame([(t,) for t in TRADES], "term string"), D.keywords(s), D.negatives(s), D.categories(s), D.aliases(s), most_skills=2, retention=365)


def _metrics(v: Views):
    """A whole load into a table that holds older postings."""
    path = f"{shared_dir(v.spark)}/star-{uuid.uuid4().hex}"
    old = _stamped(v).withColumns({"source_site": F.lit("feed"), "tech_confidence": F.lit(None).cast("double"), "salary_min": F.col("salary_min").cast("double"), "salary_max": F.col("salary_max").cast("double")})
    names = ["id", *LO.KEY, "title", "description", "company_name", "location", "salary_min", "salary_max", "salary_currency", "source_url", "posted_date", "language", "technology_category", "is_tech_role", "tech_confidence", "country_code", "employment_type", *(n for n, _ in LO.STAMPS)]
    snapshots.create(v.spark, f"{path}/jobs", old.withColumn("posted_date", F.col("posted_date").cast("timestamp")).select(*names))
    counts = ingest.load_batch(v.feed, path, "feed", AS_OF, _known(v), batch=1)
    return LO.pipeline_metrics(v.spark.createDataFrame(list(counts.items()), "stage string, n long"))


METRICS = f"""{WITH}, fe AS (SELECT id, title, 1 AS arrival FROM ({RAW}) UNION ALL SELECT id, 'again ' || title, 2 FROM ({RAW}) WHERE id % 19 = 0),
tr AS (SELECT *, {HELD} AS held FROM fe WHERE id % 17 <> 0), en AS (SELECT * FROM tr WHERE len(held) <= 2), va AS (SELECT * FROM en WHERE NOT (id % 13 = 0 AND id % 4 IN (1, 2))),
la AS (SELECT id, unnest(held) AS name FROM (SELECT * FROM va QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival DESC) = 1)),
t AS (SELECT (SELECT count(*) FROM fe) AS extracted, (SELECT count(*) FROM tr) AS transformed, (SELECT count(*) FROM en) AS enriched, (SELECT count(*) FROM va) AS validated,
  (SELECT count(DISTINCT id) FROM va WHERE id % 3 = 0) AS inserted, (SELECT count(*) FROM va) - (SELECT count(DISTINCT id) FROM va WHERE id % 3 = 0) AS updated, (SELECT count(*) FROM fe) - (SELECT count(*) FROM va) AS failed,
  (SELECT count(*) FROM jobs WHERE id % 3 <> 0 AND scraped_date < {T} - INTERVAL 365 DAY AND id NOT IN (SELECT id FROM va)) AS purged, (SELECT count(DISTINCT name) FROM la) AS skills, (SELECT count(*) FROM la) AS relationships)
SELECT *, inserted + updated AS total_loaded, CASE WHEN extracted = 0 THEN 100.0 ELSE CAST(validated AS DOUBLE) / extracted * 100 END AS success_rate FROM t"""
VALID = "coalesce(trim(source_id), '') <> '' AND coalesce(trim(title), '') <> '' AND coalesce(trim(company_name), '') <> '' AND NOT coalesce(salary_min IS NOT NULL AND salary_max IS NOT NULL AND (salary_min < 0 OR salary_max < 0), false)"
MISSING = "array_to_string(list_filter([CASE WHEN coalesce(trim(source_id), '') = '' THEN 'source_id' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(company_name), '') = '' THEN 'company' END], lambda x: x IS NOT NULL), ',')"
SWAP = "salary_min IS NOT NULL AND salary_max IS NOT NULL AND salary_min > salary_max"


def _rules(table: str, tests: dict[str, str], id_: str = "id", name: str = "rule") -> str:
    return " UNION ALL ".join(f"SELECT {id_}, '{k}' AS {name} FROM {table} WHERE {t}" for k, t in tests.items())


ENTRIES = {
    "tr_project": (
        lambda v: _done(v).select("source_id", "source_site", "title", "company_name", "location", "salary_min", "salary_max", "salary_currency", "employment_type", _time("posted_date").alias("posted"), _time("scraped_date").alias("scraped"), "source_country", "description", "source_url", "category", "acquisition_query", "acquisition_mode"),
        f"{WITH} SELECT source_id, 'feed' AS source_site, title, {COMPANY} AS company_name, location, {PAID.format('salary_min')} AS salary_min, {PAID.format('salary_max')} AS salary_max, {CURRENCY} AS salary_currency, {KIND} AS employment_type, {DAY} AS posted, coalesce({DAY}, '{AS_OF} 00:00:00') AS scraped, country_code AS source_country, '' AS description, 'https://example.com/' || source_id AS source_url, CAST(NULL AS VARCHAR) AS acquisition_mode, source_site AS category, source_site AS acquisition_query FROM ({RAW})",
    ),
    "tr_nested": (lambda v: _done(v).groupBy("company_name", "location").count(), f"{WITH} SELECT {COMPANY} AS company_name, location, count(*) AS count FROM ({RAW}) GROUP BY 1, 2"),
    "tr_salary": (lambda v: _done(v).select("source_id", "salary_min", "salary_max", "salary_currency"), f"{WITH} SELECT source_id, {PAID.format('salary_min')} AS salary_min, {PAID.format('salary_max')} AS salary_max, {CURRENCY} AS salary_currency FROM ({RAW})"),
    "tr_employment_type": (lambda v: _done(v).groupBy("employment_type").count(), f"{WITH} SELECT {KIND} AS employment_type, count(*) AS count FROM ({RAW}) GROUP BY 1"),
    "tr_datetime": (lambda v: _done(v).select("source_id", _time("posted_date").alias("posted")), f"{WITH} SELECT source_id, {DAY} AS posted FROM ({RAW})"),
    "dq_required": (lambda v: Q.required(v.drafts).select("id", F.array_join("missing", ",").alias("missing")), f"{WITH}, {DRAFTS} SELECT id, {MISSING} AS missing FROM drafts"),
    "dq_salary": (
        lambda v: _money(Q.salaries(v.drafts), "salary_min", "salary_max").select("id", "salary_min", "salary_max", F.coalesce("rejected", F.lit(False)).alias("rejected"), "warning"),
        f"{WITH}, {DRAFTS} SELECT id, CAST(CASE WHEN {SWAP} THEN salary_max ELSE salary_min END AS DOUBLE) AS salary_min, CAST(CASE WHEN {SWAP} THEN salary_min ELSE salary_max END AS DOUBLE) AS salary_max, coalesce(salary_min IS NOT NULL AND salary_max IS NOT NULL AND (salary_min < 0 OR salary_max < 0), false) AS rejected, CASE WHEN {SWAP} THEN 'salary_swapped' END AS warning FROM drafts",
    ),
    "dq_field_rules": (
        lambda v: Q.field_rules(v.drafts).select("id", F.explode("broken").alias("rule")),
        f"{WITH}, {DRAFTS} " + _rules("drafts", {"language": "NOT regexp_matches(language, '^[a-z]{2}$')", "country": "NOT regexp_matches(country_code, '^[A-Z]{2}$')", "currency": "NOT regexp_matches(salary_currency, '^[A-Z]{3}$')", "confidence": "NOT tech_confidence BETWEEN 0 AND 1", "salary": "salary_min < 0 OR salary_max < 0"}),
    ),
    "dq_consistency": (
        lambda v: Q.consistency(v.drafts).select("id", "consistent"),
        f"{WITH}, {DRAFTS} SELECT id, NOT ((is_tech_role AND (technology_category IS NULL OR tech_confidence IS NULL)) OR (NOT is_tech_role AND (technology_category IS NOT NULL OR tech_confidence IS NOT NULL OR len(matched_terms) > 0))) AS consistent FROM drafts",
    ),
    "dq_validate": (lambda v: Q.batch_counts(Q.validate(v.drafts, AS_OF)), f"{WITH}, {DRAFTS} SELECT count(*) AS total, count(*) FILTER ({VALID}) AS passed, count(*) FILTER (NOT ({VALID})) AS rejected FROM drafts"),
    "dq_strict": (
        lambda v: Q.strict_violations(v.drafts),
        f"{WITH}, {DRAFTS} " + _rules("drafts", {"source_id": "coalesce(trim(source_id), '') = ''", "title": "coalesce(trim(title), '') = ''", "company": "coalesce(trim(company_name), '') = ''", "salary_min": "salary_min < 0", "salary_max": "salary_max < 0", "salary_order": "salary_min > salary_max", "url": "NOT regexp_matches(source_url, '^https?://[^ ]+$')"}),
    ),
    "dq_constraints": (
        lambda v: Q.constraint_violations(v.drafts.unionByName(v.drafts.filter("id % 31 = 0"))),
        f"{WITH}, {DRAFTS}, d AS (SELECT * FROM drafts UNION ALL SELECT * FROM drafts WHERE id % 31 = 0) "
        + _rules("d", {"confidence": "NOT tech_confidence BETWEEN 0 AND 1", "country_length": "length(country_code) <> 2", "currency_length": "length(salary_currency) <> 3"}, "CAST(id AS VARCHAR) AS subject")
        + " UNION ALL SELECT source_site || ':' || source_id, 'unique_key' FROM d WHERE source_id IS NOT NULL GROUP BY source_site, source_id HAVING count(*) > 1",
    ),
    "load_upsert": (lambda v: _shown(LO.upsert(_stamped(v), v.incoming, AS_OF)), f"{MERGED} SELECT * FROM up"),
    "load_snapshot": (_snapshot, f"{MERGED} SELECT * FROM up"),
    "load_counts": (
        lambda v: LO.load_counts(v.existing, v.incoming),
        f"{WITH}, {BATCH}, f AS (SELECT count(DISTINCT source_site || ':' || source_id) AS inserted FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.source_site = i.source_site AND e.source_id = i.source_id)) SELECT inserted, (SELECT count(*) FROM incoming) - inserted AS updated FROM f",
    ),
    "load_skill_dim": (lambda v: LO.new_skills(_pairs(v), v.skills.filter("skill_id % 2 = 0")), f"{WITH}, {PAIRS} SELECT DISTINCT name FROM clean WHERE name NOT IN (SELECT lower(name) FROM skills WHERE skill_id % 2 = 0)"),
    "load_skill_bridge": (
        lambda v: LO.new_links(_pairs(v), v.links.filter("job_id % 8 = 0").join(v.skills, "skill_id").select("job_id", F.lower("name").alias("name")), 2 * v.many_links),
        f"{WITH}, {PAIRS} SELECT job_id, name FROM clean EXCEPT SELECT job_id, lower(name) FROM links JOIN skills USING (skill_id) WHERE job_id % 8 = 0",
    ),
    "load_purge": (lambda v: LO.purge(v.jobs, AS_OF, 365).select("id"), f"{WITH} SELECT id FROM jobs WHERE scraped_date >= {T} - INTERVAL 365 DAY"),
    "load_purge_bridge": (lambda v: LO.purge_links(v.links, LO.purge(v.jobs, AS_OF, 365)), f"{WITH} SELECT job_id, skill_id FROM links JOIN jobs ON id = job_id WHERE scraped_date >= {T} - INTERVAL 365 DAY"),
    "run_log_append": (lambda v: LO.run_durations(v.runs), f"WITH {RUNS} SELECT run_id, status, CAST(floor(epoch(completed_at)) - floor(epoch(started_at)) AS BIGINT) AS duration_seconds FROM runs"),
    "run_log_new": (
        lambda v: LO.run_durations(LO.append_run(v.runs.filter("status <> 'failed'"), v.runs.filter("status = 'failed'").drop("run_id"))),
        f"""WITH {RUNS}, old AS (SELECT * FROM runs WHERE status <> 'failed'), new AS (SELECT (SELECT max(run_id) FROM old) + row_number() OVER (ORDER BY started_at, source_site, status) AS run_id, status, started_at, completed_at FROM runs WHERE status = 'failed')
SELECT run_id, status, CAST(floor(epoch(completed_at)) - floor(epoch(started_at)) AS BIGINT) AS duration_seconds FROM (SELECT run_id, status, started_at, completed_at FROM old UNION ALL SELECT * FROM new)""",
    ),
    "pipeline_metrics": (_metrics, METRICS),
}
