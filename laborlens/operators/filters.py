"""Reusable predicates, search, pages and generic access to postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(name: str, value: int, least: int, most: int) -> int:
    """The value, where it lies in its bounds."""
    if not least <= value <= most:
        raise ValueError(f"{name} is {least} to {most}")
    return value


def active(jobs: DataFrame) -> DataFrame:
    """Postings that are shown: active and not deleted."""
    return jobs.filter("is_active and not is_deleted")


def with_predicates(jobs: DataFrame, source: str | None = None, country: str | None = None, language: str | None = None, tech_only: bool = False) -> DataFrame:
    """Active postings that meet whichever conditions are given."""
    out = active(jobs)
    if source is not None:
        out = out.filter(F.col("source_site") == source)
    if country is not None:
        out = out.filter(F.col("country_code") == country.upper())
    if language is not None:
        out = out.filter(F.col("language") == language.lower())
    return out.filter("is_tech_role") if tech_only else out


def search(
    jobs: DataFrame, company: str | None = None, location: str | None = None, source: str | None = None, min_salary: float | None = None, max_salary: float | None = None,
    country: str | None = None, category: str | None = None, employment_type: str | None = None, is_tech: bool | None = None, language: str | None = None, text: str | None = None,
) -> DataFrame:
    """Active postings that meet all given conditions; texts match anywhere and in either case."""
    if min_salary is not None and max_salary is not None and min_salary > max_salary:
        raise ValueError("min_salary exceeds max_salary")

    def like(column: str, part: str) -> Column:
        return F.col(column).ilike("%" + part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")

    tests = [
        None if company is None else like("company_name", company),
        None if location is None else like("location", location),
        None if source is None else F.col("source_site") == source,
        None if min_salary is None else F.col("salary_max") >= min_salary,
        None if max_salary is None else F.col("salary_min") <= max_salary,
        None if country is None else F.col("country_code") == country.upper(),
        None if category is None else F.col("technology_category") == category,
        None if employment_type is None else F.col("employment_type") == employment_type,
        None if is_tech is None else F.col("is_tech_role") == is_tech,
        None if language is None else F.col("language") == language.lower(),
        None if text is None else like("title", text) | like("company_name", text),
    ]
    return reduce(DataFrame.filter, [t for t in tests if t is not None], active(jobs))


def page(jobs: DataFrame, number: int, limit: int) -> DataFrame:
    """One page, newest first; postings without a date lead, as in the source system."""
    if number < 1:
        raise ValueError("pages begin at 1")
    within("limit", limit, 1, 100)
    return jobs.orderBy(F.desc_nulls_first("posted_date"), F.desc("id")).offset((number - 1) * limit).limit(limit)


def count_pages(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / limit).cast("long"))


def by_id(jobs: DataFrame, id_: int) -> DataFrame:
    return active(jobs).filter(F.col("id") == id_)


def with_skills(jobs: DataFrame, links: DataFrame, skills: DataFrame) -> DataFrame:
    """Each posting with the sorted names of its skills, empty where it has none."""
    names = links.join(skills, "skill_id").groupBy(F.col("job_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("skill_names"))
    return jobs.join(names, "id", "left").withColumn("skill_names", F.coalesce("skill_names", F.array().cast("array<string>")))


def equal_to(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values; parameters of None are ignored."""
    return reduce(DataFrame.filter, [F.col(k) == v for k, v in values.items() if v is not None], df)
