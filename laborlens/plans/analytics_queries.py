"""Registered queries over postings, skills, runs and request logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.operators import analytics as A
from laborlens.operators import filters as L
from laborlens.plans.views import AS_OF, JOBS, RUNS, Views

WITH = "WITH " + JOBS
T = f"TIMESTAMP '{AS_OF}'"
PCT = "CASE WHEN sum(count) OVER () = 0 THEN 0.0 ELSE count / sum(count) OVER () * 100 END AS percentage"


def _pct(n: str, d: str) -> str:
    return f"CAST(CASE WHEN {d} = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / {d} * 100 END AS DOUBLE)"


def _shared(inner: str) -> str:
    """Adds the share of what is returned to (key, count) rows."""
    return f"{WITH}, top AS ({inner}) SELECT *, CAST(CAST(count AS DOUBLE) / sum(count) OVER () * 100 AS DOUBLE) AS percentage FROM top"


def _top(key: str, name: str, limit: int = 10, extra: str = "") -> str:
    return _shared(f"SELECT {key} AS {name}, count(*) AS count FROM act {extra} GROUP BY 1 ORDER BY count DESC, {name} ASC NULLS FIRST LIMIT {limit}")


def _dist(key: str, name: str, extra: str = "", source: str = "act") -> str:
    return _shared(f"SELECT {key} AS {name}, count(*) AS count FROM {source} {extra} GROUP BY 1")


def _skills(extra: str = "", limit: int = 10) -> str:
    return _shared(f"SELECT name AS skill, count(*) AS count FROM links JOIN act ON id = job_id JOIN skills USING (skill_id) {extra} GROUP BY 1 ORDER BY count DESC, skill LIMIT {limit}")


MEAN = "CAST(sum({0}) AS DOUBLE) / count({0})"
SALARY_BY = (
    "SELECT {0} AS {1}, CAST(sum(salary_min + salary_max) AS DOUBLE) / (2 * count(*)) AS avg_salary, count(*) AS job_count, CAST(min(salary_min) AS DOUBLE) AS min_salary,"
    " CAST(max(salary_max) AS DOUBLE) AS max_salary FROM act WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL AND {0} IS NOT NULL GROUP BY 1"
)
PAY = (
    f"SELECT {MEAN.format('salary_min')} AS avg_min, {MEAN.format('salary_max')} AS avg_max, CAST(min(salary_min) AS DOUBLE) AS min_salary, CAST(max(salary_max) AS DOUBLE) AS max_salary,"
    " quantile_cont(CAST(salary_min AS DOUBLE), 0.5) AS median_salary, count(*) AS job_count FROM act WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL"
)
STATS = f"""paid AS (SELECT * FROM act WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL),
first AS (SELECT salary_currency, count(*) AS n, {MEAN.format('salary_min')} AS a, min(salary_min) AS lo, max(salary_max) AS hi FROM paid GROUP BY 1 ORDER BY n DESC, salary_currency ASC NULLS FIRST LIMIT 1),
whole AS (SELECT quantile_cont(CAST(salary_min AS DOUBLE), 0.5) AS median FROM paid),
stats AS (SELECT coalesce(salary_currency, 'USD') AS currency, nullif(a, 0) AS avg_salary, CAST(lo AS DOUBLE) AS min_salary, CAST(hi AS DOUBLE) AS max_salary, nullif(median, 0) AS median_salary, coalesce(n, 0) AS job_count
          FROM whole LEFT JOIN first ON true)"""
TREND = "SELECT strftime(posted_date, '%Y-%m-%d') AS day, count(*) AS count FROM act WHERE posted_date >= " + T + " - INTERVAL {0} DAY GROUP BY 1"
COLUMNS = "id, title, company_name, location, source_site, employment_type, strftime(posted_date, '%Y-%m-%d') AS posted"


def _shown(df):
    return df.select("id", "title", "company_name", "location", "source_site", "employment_type", F.date_format("posted_date", "yyyy-MM-dd").alias("posted"))


BUCKETS = """(0, '0-30K', 0, 30000), (1, '30K-50K', 30000, 50000), (2, '50K-70K', 50000, 70000), (3, '70K-90K', 70000, 90000), (4, '90K-120K', 90000, 120000),
(5, '120K-150K', 120000, 150000), (6, '150K-200K', 150000, 200000), (7, '200K+', 200000, NULL)"""


def _bucket_sql() -> str:
    return f"{WITH}, top AS (SELECT position, salary_range, count(id) AS count FROM (VALUES {BUCKETS}) b(position, salary_range, lo, hi) LEFT JOIN act ON salary_min >= lo AND (hi IS NULL OR salary_min < hi) GROUP BY 1, 2) SELECT *, {_pct('count', 'sum(count) OVER ()')} AS percentage FROM top"


def _section(name: str, inner: str, key: str, value: str) -> str:
    return f"SELECT '{name}' AS section, CAST(row_number() OVER (ORDER BY {value} DESC, {key} ASC NULLS FIRST) AS INTEGER) AS position, CAST({key} AS VARCHAR) AS name, CAST({value} AS DOUBLE) AS value FROM ({inner})"


DASHBOARD = f"{WITH}, {STATS} " + " UNION ALL ".join(
    [
        _section("total", "SELECT 'total' AS k, count(*) AS v FROM act", "k", "v"),
        _section("recent", f"SELECT 'recent' AS k, count(*) AS v FROM act WHERE posted_date >= {T} - INTERVAL 7 DAY", "k", "v"),
        "SELECT 'different' AS section, position, name, value FROM (SELECT 1 AS position, 'companies' AS name, CAST(count(DISTINCT company_name) AS DOUBLE) AS value FROM jobs UNION ALL SELECT 2, 'locations', count(DISTINCT location) FROM jobs UNION ALL SELECT 3, 'skills', count(*) FROM skills)",
        "SELECT 'salary', position, name, value FROM (SELECT 1 AS position, 'avg_salary' AS name, CAST(avg_salary AS DOUBLE) AS value FROM stats UNION ALL SELECT 2, 'min_salary', min_salary FROM stats UNION ALL SELECT 3, 'max_salary', max_salary FROM stats UNION ALL SELECT 4, 'median_salary', median_salary FROM stats UNION ALL SELECT 5, 'job_count', job_count FROM stats)",
        _section("currency", "SELECT currency AS k, job_count AS v FROM stats", "k", "v"),
        _section("skills", "SELECT name AS k, count(*) AS v FROM links JOIN act ON id = job_id JOIN skills USING (skill_id) GROUP BY 1 ORDER BY v DESC, k LIMIT 10", "k", "v"),
        _section("companies", "SELECT company_name AS k, count(*) AS v FROM act GROUP BY 1 ORDER BY v DESC, k LIMIT 10", "k", "v"),
        _section("locations", "SELECT location AS k, count(*) AS v FROM act GROUP BY 1 ORDER BY v DESC, k LIMIT 10", "k", "v"),
        _section("employment", "SELECT employment_type AS k, count(*) AS v FROM act GROUP BY 1", "k", "v"),
        _section("trend", TREND.format(30), "day", "count"),
    ]
)
AGE = f"""CASE WHEN last IS NULL THEN NULL WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ago' WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ago'
WHEN s // 60 > 0 THEN (s // 60) || 'm ago' ELSE 'Just now' END"""

ENTRIES = {
    "an_top_skills": (lambda v: A.top_skills(v.jobs, v.links, v.skills), _skills()),
    "an_top_companies": (lambda v: A.top_by(v.jobs, "company_name", "company"), _top("company_name", "company")),
    "an_jobs_by_location": (lambda v: A.top_by(v.jobs, "location", "location"), _top("location", "location")),
    "an_salary_stats": (lambda v: A.salary_stats(v.jobs), f"{WITH}, {STATS} SELECT * FROM stats"),
    "an_employment_types": (lambda v: A.distribution(L.active(v.jobs), "employment_type", "employment_type"), _dist("employment_type", "employment_type")),
    "an_salary_by_location": (lambda v: A.salary_by(v.jobs, "location", "location"), f"{WITH} {SALARY_BY.format('location', 'location')} ORDER BY job_count DESC, location LIMIT 10"),
    "an_salary_by_company": (lambda v: A.salary_by(v.jobs, "company_name", "company"), f"{WITH} {SALARY_BY.format('company_name', 'company')} ORDER BY job_count DESC, company LIMIT 10"),
    "an_posting_trend": (lambda v: A.posting_trend(v.jobs, AS_OF), f"{WITH}, t AS ({TREND.format(365)}) SELECT *, CAST(sum(count) OVER (ORDER BY day) AS BIGINT) AS running_total FROM t"),
    "an_recent_jobs": (lambda v: _shown(A.recent_jobs(v.jobs, AS_OF, 90)), f"{WITH} SELECT {COLUMNS} FROM act WHERE posted_date >= {T} - INTERVAL 90 DAY ORDER BY posted_date DESC, id DESC LIMIT 20"),
    "an_salary_distribution": (lambda v: A.salary_distribution(v.jobs), _bucket_sql()),
    "an_total_jobs": (lambda v: L.active(v.jobs).agg(F.count("*").alias("total_jobs")), f"{WITH} SELECT count(*) AS total_jobs FROM act"),
    "an_recent_count": (lambda v: A.recent_jobs(v.jobs, AS_OF, 90, 2**31 - 1).agg(F.count("*").alias("recent_jobs")), f"{WITH} SELECT count(*) AS recent_jobs FROM act WHERE posted_date >= {T} - INTERVAL 90 DAY"),
    "an_source_count": (lambda v: L.active(v.jobs).groupBy("source_site").count(), f"{WITH} SELECT source_site, count(*) AS count FROM act GROUP BY 1"),
    "an_jobs_by_source": (lambda v: _shown(L.with_predicates(v.jobs, source="BUILDING")), f"{WITH} SELECT {COLUMNS} FROM act WHERE source_site = 'BUILDING'"),
    "an_completeness": (
        lambda v: A.completeness(v.jobs),
        f"{WITH}, t AS (SELECT count(*) AS total, count(company_name) AS with_company, count(location) AS with_location, count(*) FILTER (salary_min IS NOT NULL AND salary_max IS NOT NULL) AS with_salary, count(employment_type) AS with_employment_type, count(posted_date) AS with_posted_date FROM act) SELECT *, "
        + ", ".join(f"{_pct(f'with_{k}', 'total')} AS {k}_percentage" for k in ("company", "location", "salary", "employment_type", "posted_date")) + " FROM t",
    ),
    "an_distinct_sources": (lambda v: L.active(v.jobs).select("source_site").distinct(), f"{WITH} SELECT DISTINCT source_site FROM act"),
    "an_skill_links": (lambda v: A.skill_links(v.links, v.jobs), f"{WITH} SELECT l AS links, CASE WHEN j = 0 THEN 0.0 ELSE CAST(l AS DOUBLE) / j END AS avg_skills_per_job FROM (SELECT (SELECT count(*) FROM links) AS l, (SELECT count(*) FROM act) AS j)"),
    "an_dataset_summary": (
        lambda v: A.dataset_summary(v.jobs, v.skills),
        f"{WITH} SELECT count(*) FILTER (is_active AND NOT is_deleted) AS total_jobs, count(DISTINCT company_name) AS companies, count(DISTINCT location) AS locations, strftime(min(posted_date), '%Y-%m-%d') AS first_posted, strftime(max(posted_date), '%Y-%m-%d') AS last_posted, (SELECT count(*) FROM skills) AS skills FROM jobs",
    ),
    "an_overview": (
        lambda v: A.overview(v.jobs, v.links, v.skills, AS_OF),
        f"{WITH}, {STATS} SELECT (SELECT count(*) FROM act) AS total_jobs, (SELECT count(*) FROM act WHERE posted_date >= {T} - INTERVAL 7 DAY) AS recent_jobs, (SELECT company_name FROM act GROUP BY 1 ORDER BY count(*) DESC, company_name LIMIT 1) AS top_company,"
        " (SELECT name FROM links JOIN act ON id = job_id JOIN skills USING (skill_id) GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 1) AS top_skill, avg_salary FROM stats",
    ),
    "an_dashboard_summary": (lambda v: A.dashboard_summary(v.jobs, v.links, v.skills, AS_OF), DASHBOARD),
    "an_language_dist": (lambda v: A.distribution(L.active(v.jobs), "language", "language", "unknown"), _dist("coalesce(language, 'unknown')", "language")),
    "an_language_by_country": (lambda v: A.language_by_country(v.jobs), f"{WITH} SELECT country_code AS country, coalesce(language, 'unknown') AS language, count(*) AS count FROM act WHERE country_code IS NOT NULL GROUP BY 1, 2"),
    "an_english_split": (lambda v: A.english_split(v.jobs), f"{WITH}, t AS (SELECT count(*) AS total, count(*) FILTER (language = 'en') AS english FROM act) SELECT total, english, total - english AS non_english, {_pct('english', 'total')} AS english_percentage FROM t"),
    "an_language_salary": (lambda v: A.salary_by(v.jobs, "language", "language", None), f"{WITH} {SALARY_BY.format('language', 'language')}"),
    "an_tech_split": (lambda v: A.tech_split(v.jobs), f"{WITH}, t AS (SELECT count(*) AS total, count(*) FILTER (is_tech_role) AS tech FROM act) SELECT total, tech, total - tech AS non_tech, {_pct('tech', 'total')} AS tech_percentage FROM t"),
    "an_tech_categories": (lambda v: A.distribution(L.active(v.jobs).filter("is_tech_role and technology_category is not null"), "technology_category", "category"), _dist("technology_category", "category", "WHERE is_tech_role AND technology_category IS NOT NULL")),
    "an_tech_by_country": (lambda v: A.tech_by_country(v.jobs), f"{WITH}, t AS (SELECT country_code AS country, count(*) AS total, count(*) FILTER (is_tech_role) AS tech FROM act WHERE country_code IS NOT NULL GROUP BY 1) SELECT *, {_pct('tech', 'total')} AS tech_percentage FROM t"),
    "an_tech_skills": (lambda v: A.top_skills(v.jobs.filter("is_tech_role"), v.links, v.skills), _skills("WHERE is_tech_role")),
    "an_tech_salary": (lambda v: A.pay_summary(v.jobs.filter("is_tech_role")), f"{WITH} {PAY} AND is_tech_role"),
    "an_enriched_skills": (lambda v: A.top_skills(v.jobs.filter("country_code = 'NATION_13' and is_tech_role"), v.links, v.skills, 20), _skills("WHERE country_code = 'NATION_13' AND is_tech_role", 20)),
    "an_country_dist": (lambda v: A.distribution(L.active(v.jobs).filter("country_code is not null"), "country_code", "country"), _dist("country_code", "country", "WHERE country_code IS NOT NULL")),
    "an_enriched_salary": (lambda v: A.pay_summary(v.jobs.filter("country_code = 'NATION_13'")), f"{WITH} {PAY} AND country_code = 'NATION_13'"),
    "an_category_dist_all": (lambda v: A.distribution(L.active(v.jobs).filter("technology_category is not null"), "technology_category", "category"), _dist("technology_category", "category", "WHERE technology_category IS NOT NULL")),
    "an_job_stats": (
        lambda v: A.job_stats(v.jobs, v.skills),
        f"{WITH} SELECT count(*) AS total, count(DISTINCT company_name) AS companies, count(DISTINCT country_code) AS countries, {MEAN.format('salary_min')} AS avg_min, {MEAN.format('salary_max')} AS avg_max, count(*) FILTER (is_tech_role) AS tech, (SELECT count(*) FROM skills) AS skills FROM act",
    ),
    "an_companies_hiring": (lambda v: A.companies_hiring(v.jobs), f"{WITH} SELECT least(count(DISTINCT company_name), 1000) AS companies FROM act"),
    "an_last_run": (
        lambda v: A.last_run(v.runs).select("run_id", "status", "source_site", "records_processed", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed")),
        f"WITH {RUNS} SELECT run_id, status, source_site, records_processed, strftime(timezone('UTC', completed_at), '%Y-%m-%d %H:%M:%S') AS completed FROM runs WHERE status IN ('completed', 'failed') ORDER BY completed_at DESC, started_at DESC, run_id DESC LIMIT 1",
    ),
    "an_run_status": (
        lambda v: A.run_status(v.runs, "2024-03-01"),
        f"WITH {RUNS}, t AS (SELECT CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'Running' ELSE 'Idle' END AS state, max(completed_at) FILTER (status IN ('completed', 'failed')) AS last FROM runs), u AS (SELECT *, CAST(epoch(TIMESTAMP '2024-03-01') - epoch(last) AS BIGINT) AS s FROM t) SELECT state, {AGE} AS last_run FROM u",
    ),
    "an_request_metrics": (
        lambda v: A.request_metrics(v.requests),
        f"""WITH m AS (SELECT event_id, '/api/' || event_type || '/{{id}}' AS endpoint, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, coalesce(value, 0.0) AS duration_ms FROM events),
r AS (SELECT endpoint, duration_ms, row_number() OVER (PARTITION BY endpoint ORDER BY event_id DESC) AS k FROM m), d AS (SELECT endpoint, list(duration_ms ORDER BY duration_ms) AS d FROM r WHERE k <= 1000 GROUP BY 1),
t AS (SELECT endpoint, count(*) AS requests, count(*) FILTER (status >= 400) AS errors FROM m GROUP BY 1)
SELECT endpoint, requests, errors, {_pct('errors', 'requests')} AS error_rate, round(list_sum(d) / len(d), 6) AS avg_ms, d[CAST(floor(len(d) * 0.95) AS BIGINT) + 1] AS p95_ms, d[1] AS min_ms, d[-1] AS max_ms FROM t JOIN d USING (endpoint)""",
    ),
    "fl_predicates": (lambda v: _shown(L.with_predicates(v.jobs, source="MACHINERY", country="nation_13", language="ES", tech_only=True)), f"{WITH} SELECT {COLUMNS} FROM act WHERE source_site = 'MACHINERY' AND country_code = 'NATION_13' AND language = 'es' AND is_tech_role"),
    "fl_search": (
        lambda v: _shown(L.search(v.jobs, company="customer#0", location="nation_1", min_salary=20000, max_salary=60000, is_tech=True, text="promo")),
        f"{WITH} SELECT {COLUMNS} FROM act WHERE company_name ILIKE '%customer#0%' AND location ILIKE '%nation_1%' AND salary_max >= 20000 AND salary_min <= 60000 AND is_tech_role AND (title ILIKE '%promo%' OR company_name ILIKE '%promo%')",
    ),
    "fl_page": (lambda v: _shown(L.page(L.active(v.jobs), 3, 25)), f"{WITH} SELECT {COLUMNS} FROM act ORDER BY posted_date DESC NULLS FIRST, id DESC LIMIT 25 OFFSET 50"),
    "fl_count_pages": (lambda v: L.count_pages(L.active(v.jobs), 25), f"{WITH} SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM act"),
    "fl_by_id": (lambda v: _shown(L.by_id(v.jobs, 101)), f"{WITH} SELECT {COLUMNS} FROM act WHERE id = 101"),
    "fl_with_skills": (
        lambda v: L.with_skills(L.active(v.jobs), v.links, v.skills).select("id", F.explode_outer("skill_names").alias("skill")),
        f"{WITH}, n AS (SELECT DISTINCT job_id, name FROM links JOIN skills USING (skill_id)) SELECT id, name AS skill FROM act LEFT JOIN n ON job_id = id",
    ),
    "fl_generic": (lambda v: _shown(L.equal_to(v.jobs, source_site="FURNITURE", language="de", country_code=None).orderBy("id").limit(50)), f"{WITH} SELECT {COLUMNS} FROM jobs WHERE source_site = 'FURNITURE' AND language = 'de' ORDER BY id LIMIT 50"),
}
