"""Analytic questions over postings, skills, runs and request logs.

Percentages of nothing are 0. Counts are in descending order with the key ascending behind, so results
don't depend on chance. Averages are exact decimal sums over counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.operators.filters import active, within
from laborlens.operators.running import median
from laborlens.session import stored

#: Lower bounds of the salary histogram's ranges; the last one is open.
SALARY_BOUNDS = (0, 30_000, 50_000, 70_000, 90_000, 120_000, 150_000, 200_000)
REQUEST_SAMPLES = 1000
#: The most rows and days that a question may ask for.
MOST_ROWS, MOST_DAYS = 100, 365


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100).cast("double")


def mean(column: str) -> Column:
    """Average of a decimal column as a double: an exact sum over a count."""
    return F.sum(column).cast("double") / F.count(column)


def ranked(counts: DataFrame, key: str, limit: int) -> DataFrame:
    """The largest counts with their share of what is returned. The window sees at most `limit` rows."""
    within("limit", limit, 1, MOST_ROWS)
    top = counts.orderBy(F.desc("count"), F.asc_nulls_first(key)).limit(limit)
    return top.withColumn("percentage", share(F.col("count"), F.sum("count").over(Window.partitionBy(F.lit(1)))))


def top_skills(jobs: DataFrame, links: DataFrame, skills: DataFrame, limit: int = 10) -> DataFrame:
    """Skills of active postings. Links are counted by key before the names are joined."""
    ids = active(jobs).select(F.col("id").alias("job_id"))
    counts = links.join(ids, "job_id", "left_semi").groupBy("skill_id").count()
    return ranked(counts.join(skills, "skill_id").groupBy(F.col("name").alias("skill")).agg(F.sum("count").alias("count")), "skill", limit)


def top_by(jobs: DataFrame, key: str, name: str, limit: int = 10) -> DataFrame:
    return ranked(active(jobs).groupBy(F.col(key).alias(name)).count(), name, limit)


def distribution(jobs: DataFrame, key: str, name: str, unknown: str | None = None) -> DataFrame:
    """Counts of every value with shares of all."""
    column = F.col(key) if unknown is None else F.coalesce(key, F.lit(unknown))
    counts = jobs.groupBy(column.alias(name)).count()
    return counts.withColumn("percentage", share(F.col("count"), F.sum("count").over(Window.partitionBy(F.lit(1)))))


def salary_stats(jobs: DataFrame) -> DataFrame:
    """Statistics of the most frequent currency; the median is over all currencies. Averages of 0 are null."""
    paid = active(jobs).filter("salary_min is not null and salary_max is not null")
    groups = paid.groupBy("salary_currency").agg(F.count("*").alias("n"), mean("salary_min").alias("avg_salary"), F.min("salary_min").alias("lo"), F.max("salary_max").alias("hi"))
    first = groups.orderBy(F.desc("n"), F.asc_nulls_first("salary_currency")).limit(1)
    whole = median(paid, F.col("salary_min"))
    both = whole.join(first, F.lit(True), "left")
    return both.select(
        F.coalesce("salary_currency", F.lit("USD")).alias("currency"), F.expr("nullif(avg_salary, 0D)").alias("avg_salary"), F.col("lo").cast("double").alias("min_salary"),
        F.col("hi").cast("double").alias("max_salary"), F.expr("nullif(median, 0D)").alias("median_salary"), F.coalesce("n", F.lit(0)).cast("long").alias("job_count"),
    )


def salary_by(jobs: DataFrame, key: str, name: str, limit: int | None = 10) -> DataFrame:
    """Average of the middle of the range, count, least and greatest salary."""
    paid = active(jobs).filter(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull() & F.col(key).isNotNull())
    out = paid.groupBy(F.col(key).alias(name)).agg(
        (F.sum(F.col("salary_min") + F.col("salary_max")).cast("double") / (2 * F.count("*"))).alias("avg_salary"), F.count("*").alias("job_count"),
        F.min("salary_min").cast("double").alias("min_salary"), F.max("salary_max").cast("double").alias("max_salary"),
    )
    return out if limit is None else out.orderBy(F.desc("job_count"), name).limit(within("limit", limit, 1, MOST_ROWS))


def posting_trend(jobs: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Postings a day in the last days, with their running total."""
    within("days", days, 1, MOST_DAYS)
    recent = active(jobs).filter(F.col("posted_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    counts = recent.groupBy(F.to_date("posted_date").alias("day")).count()
    total = F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "count", total.alias("running_total"))


def recent_jobs(jobs: DataFrame, as_of: str, days: int = 30, limit: int = 20, source: str | None = None) -> DataFrame:
    found = active(jobs).filter(F.col("posted_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    if source is not None:
        found = found.filter(F.col("source_site") == source)
    return found.orderBy(F.desc("posted_date"), F.desc("id")).limit(limit)


def salary_distribution(jobs: DataFrame) -> DataFrame:
    """Postings in each range of the least salary, in one pass; empty ranges are kept, negative salaries fall nowhere."""
    lows, highs = SALARY_BOUNDS, (*SALARY_BOUNDS[1:], None)
    short = lambda x: f"{x // 1000}K" if x else "0"
    names = [f"{short(lo)}-{short(hi)}" if hi else f"{short(lo)}+" for lo, hi in zip(lows, highs, strict=True)]
    counts = active(jobs).agg(*(F.count_if((F.col("salary_min") >= lo) & (F.lit(True) if hi is None else F.col("salary_min") < hi)).alias(f"n{k}") for k, (lo, hi) in enumerate(zip(lows, highs, strict=True))))
    stacked = counts.selectExpr(f"stack({len(names)}, " + ", ".join(f"{k}, '{n}', n{k}" for k, n in enumerate(names)) + ") as (position, salary_range, count)")
    return stacked.withColumn("percentage", share(F.col("count"), F.sum("count").over(Window.partitionBy(F.lit(1)))))


def completeness(jobs: DataFrame) -> DataFrame:
    """How many active postings have each field, in one pass."""
    salary = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull()
    tests = {"company": F.col("company_name").isNotNull(), "location": F.col("location").isNotNull(), "salary": salary, "employment_type": F.col("employment_type").isNotNull(), "posted_date": F.col("posted_date").isNotNull()}
    out = active(jobs).agg(F.count("*").alias("total"), *(F.count_if(t).alias(f"with_{k}") for k, t in tests.items()))
    return out.select("*", *(share(F.col(f"with_{k}"), F.col("total")).alias(f"{k}_percentage") for k in tests))


def dataset_summary(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Active total; companies, locations and dates are over all rows."""
    out = jobs.agg(
        F.count_if(F.col("is_active") & ~F.col("is_deleted")).alias("total_jobs"), F.count_distinct("company_name").alias("companies"), F.count_distinct("location").alias("locations"),
        F.date_format(F.min("posted_date"), "yyyy-MM-dd").alias("first_posted"), F.date_format(F.max("posted_date"), "yyyy-MM-dd").alias("last_posted"),
    )
    return out.join(skills.agg(F.count("*").alias("skills")), F.lit(True))


def overview(jobs: DataFrame, links: DataFrame, skills: DataFrame, as_of: str) -> DataFrame:
    """One row: total, last week's postings, top company, top skill, average salary."""
    recent = F.col("posted_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(7))
    total = active(jobs).agg(F.count("*").alias("total_jobs"), F.count_if(recent).alias("recent_jobs"))
    company = top_by(jobs, "company_name", "top_company", 1).select("top_company")
    skill = top_skills(jobs, links, skills, 1).select(F.col("skill").alias("top_skill"))
    pay = salary_stats(jobs).select("avg_salary")
    return total.join(company, F.lit(True), "left").join(skill, F.lit(True), "left").join(pay, F.lit(True), "left")


def dashboard_summary(jobs: DataFrame, links: DataFrame, skills: DataFrame, as_of: str) -> DataFrame:
    """All parts of the summary page in long form: section, position, name, value. Postings are written once, as all parts read them."""
    jobs = stored(jobs.select("id", "company_name", "location", "employment_type", "posted_date", "salary_min", "salary_max", "salary_currency", "is_active", "is_deleted"), "jobs")

    def part(section: str, df: DataFrame, name: str, value: str) -> DataFrame:
        order = Window.partitionBy(F.lit(1)).orderBy(F.desc(value), F.asc_nulls_first(name))
        return df.select(F.lit(section).alias("section"), F.row_number().over(order).alias("position"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))

    def rows(section: str, one: DataFrame, *names: str) -> DataFrame:
        """The columns of a single row, each as a part."""
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for k, n in enumerate(names, 1))))
        return one.select(each.alias("e")).select(F.lit(section).alias("section"), "e.*")

    recent = F.col("posted_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(7))
    shown = active(jobs).agg(F.count("*").alias("total"), F.count_if(recent).alias("recent"))
    # unlike the rest, these are counted over all postings
    different = jobs.agg(F.count_distinct("company_name").alias("companies"), F.count_distinct("location").alias("locations")).join(skills.agg(F.count("*").alias("skills")), F.lit(True))
    pay = salary_stats(jobs)
    parts = [
        rows("total", shown, "total"), rows("recent", shown, "recent"), rows("different", different, "companies", "locations", "skills"), part("skills", top_skills(jobs, links, skills), "skill", "count"),
        part("companies", top_by(jobs, "company_name", "company"), "company", "count"), part("locations", top_by(jobs, "location", "location"), "location", "count"),
        rows("salary", pay, "avg_salary", "min_salary", "max_salary", "median_salary", "job_count"), part("currency", pay, "currency", "job_count"),
        part("employment", distribution(active(jobs), "employment_type", "employment_type"), "employment_type", "count"), part("trend", posting_trend(jobs, as_of, 30), "day", "count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def english_split(jobs: DataFrame) -> DataFrame:
    """Postings without a language count as not English."""
    out = active(jobs).agg(F.count("*").alias("total"), F.count_if(F.col("language") == "en").alias("english"))
    return out.select("total", "english", (F.col("total") - F.col("english")).alias("non_english"), share(F.col("english"), F.col("total")).alias("english_percentage"))


def tech_split(jobs: DataFrame) -> DataFrame:
    out = active(jobs).agg(F.count("*").alias("total"), F.count_if("is_tech_role").alias("tech"))
    return out.select("total", "tech", (F.col("total") - F.col("tech")).alias("non_tech"), share(F.col("tech"), F.col("total")).alias("tech_percentage"))


def tech_by_country(jobs: DataFrame) -> DataFrame:
    out = active(jobs).filter("country_code is not null").groupBy(F.col("country_code").alias("country")).agg(F.count("*").alias("total"), F.count_if("is_tech_role").alias("tech"))
    return out.withColumn("tech_percentage", share(F.col("tech"), F.col("total")))


def language_by_country(jobs: DataFrame) -> DataFrame:
    return active(jobs).filter("country_code is not null").groupBy(F.col("country_code").alias("country"), F.coalesce("language", F.lit("unknown")).alias("language")).count()


def pay_summary(jobs: DataFrame) -> DataFrame:
    """Averages, extremes and exact median of active postings with both salaries, whatever the currency."""
    paid = active(jobs).filter("salary_min is not null and salary_max is not null")
    out = paid.agg(
        mean("salary_min").alias("avg_min"), mean("salary_max").alias("avg_max"), F.min("salary_min").cast("double").alias("min_salary"), F.max("salary_max").cast("double").alias("max_salary"),
        F.count("*").alias("job_count"),
    )
    return out.join(median(paid, F.col("salary_min")).withColumnRenamed("median", "median_salary"), F.lit(True))


def job_stats(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    out = active(jobs).agg(
        F.count("*").alias("total"), F.count_distinct("company_name").alias("companies"), F.count_distinct("country_code").alias("countries"), mean("salary_min").alias("avg_min"),
        mean("salary_max").alias("avg_max"), F.count_if("is_tech_role").alias("tech"),
    )
    return out.join(skills.agg(F.count("*").alias("skills")), F.lit(True))


def companies_hiring(jobs: DataFrame, cap: int = 1000) -> DataFrame:
    """Number of companies, shown as at most `cap`."""
    return active(jobs).agg(F.least(F.count_distinct("company_name"), F.lit(cap)).cast("long").alias("companies"))


def skill_links(links: DataFrame, jobs: DataFrame) -> DataFrame:
    n = links.agg(F.count("*").alias("links"))
    out = n.join(active(jobs).agg(F.count("*").alias("jobs")), F.lit(True))
    return out.select("links", (F.when(F.col("jobs") == 0, 0.0).otherwise(F.col("links") / F.col("jobs"))).alias("avg_skills_per_job"))


def last_run(runs: DataFrame) -> DataFrame:
    """The latest finished run."""
    return runs.filter("status in ('completed', 'failed')").orderBy(F.desc("completed_at"), F.desc("started_at"), F.desc("run_id")).limit(1)


def run_status(runs: DataFrame, as_of: str) -> DataFrame:
    """Whether a run is going on, and how long ago the last one ended."""
    state = runs.agg(F.when(F.count_if(F.col("status") == "running") > 0, "Running").otherwise("Idle").alias("state"), F.max(F.when(F.col("status").isin("completed", "failed"), F.col("completed_at"))).alias("last"))
    s = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    age = F.when(d > 0, F.format_string("%dd %dh ago", d, h)).when(h > 0, F.format_string("%dh %dm ago", h, m)).when(m > 0, F.format_string("%dm ago", m)).otherwise("Just now")
    return state.select("state", F.when(F.col("last").isNotNull(), age).alias("last_run"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """Per endpoint with ids masked: requests and errors of all; durations of the last REQUEST_SAMPLES."""
    masked = requests.withColumn("endpoint", F.regexp_replace("endpoint", r"/\d+", "/{id}"))
    totals = masked.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
    last = masked.withColumn("rank", F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("event_id")))).filter(F.col("rank") <= REQUEST_SAMPLES)
    sorted_ = last.groupBy("endpoint").agg(F.sort_array(F.collect_list("duration_ms")).alias("d"))
    times = sorted_.select("endpoint", F.element_at("d", (F.floor(F.size("d") * 0.95) + 1).cast("int")).alias("p95_ms"), F.array_min("d").alias("min_ms"), F.array_max("d").alias("max_ms"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d"), 6).alias("avg_ms"))
    return totals.join(times, "endpoint").select("endpoint", "requests", "errors", share(F.col("errors"), F.col("requests")).alias("error_rate"), "avg_ms", "p95_ms", "min_ms", "max_ms")
