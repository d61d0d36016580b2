"""Idempotent load into the postings-skills star, retention, run log and stage counts.

Parquet has no MERGE: an upsert is a join and a rewrite, to a new path, never the one being read. sources/snapshots.py does that for the parts of
a table that a batch touches.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.session import dealt

KEY = ["source_site", "source_id"]
#: Columns that a later record overwrites, beside scraped_date, is_active and is_deleted, and what stands for null in them.
UPDATED = [
    "title", "description", "company_name", "location", "salary_min", "salary_max", "salary_currency", "source_url", "posted_date",
    "technology_category", "is_tech_role", "country_code", "employment_type",
]
DEFAULTS = {"description": "", "company_name": "Unknown", "source_url": ""}
STAMPS = [("scraped_date", T.TimestampType()), ("is_active", T.BooleanType()), ("is_deleted", T.BooleanType())]


def last_per_key(incoming: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.desc("arrival"))
    return incoming.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def posting_schema(rows: DataFrame) -> T.StructType:
    """Columns of a table of such postings: the rows' own and the stamps of a load."""
    stamps = dict(STAMPS)
    return T.StructType([*(f for f in rows.schema if f.name not in stamps), *(T.StructField(n, t) for n, t in STAMPS)])


def upsert(existing: DataFrame, incoming: DataFrame, as_of: str, flag: str | None = None) -> DataFrame:
    """Existing rows with what came in, the last arrival of each key. The id of a known posting and all columns but UPDATED stay; what came in is active
    again and seen at as_of. Columns are those of the existing rows; flag: one more that tells rows of new keys."""
    rows = last_per_key(incoming) if "arrival" in incoming.columns else incoming
    stamps = dict(STAMPS)
    own = [c for c in rows.columns if c in existing.columns and c not in {*KEY, *stamps}]
    new = rows.select(*KEY, F.lit(True).alias("came"), *(F.col(c).alias(f"new_{c}") for c in own))
    both = existing.withColumn("known", F.lit(True)).join(new, KEY, "full_outer")
    came, known = F.coalesce("came", F.lit(False)), F.coalesce("known", F.lit(False))
    told = {"scraped_date": F.when(came, F.lit(as_of).cast("timestamp")).otherwise(F.col("scraped_date")), "is_active": came | F.col("is_active"), "is_deleted": ~came & F.col("is_deleted")}

    def value(c: str) -> Column:
        if c in stamps or c in KEY or c not in own:
            return told.get(c, F.col(c))
        given = F.coalesce(F.col(f"new_{c}"), F.lit(DEFAULTS[c])) if c in DEFAULTS else F.col(f"new_{c}")
        return F.when(came if c in UPDATED else ~known, given).otherwise(F.col(c))

    return both.select(*(value(c).alias(c) for c in existing.columns), *([(~known).alias(flag)] if flag else []))


def counted(seen: Observation, name: str) -> int:
    """A count of observed(), after its rows were written. Where Spark finds beforehand that there are no rows, it takes what would count them out of the plan."""
    try:
        return seen.get[name]
    except Py4JJavaError as none:
        if "AssertionError" not in str(none.java_exception):
            raise
        return 0


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """Rows that are counted as they pass, so that a stage needs no pass of its own to be counted."""
    seen = Observation(name)
    return rows.observe(seen, *(c.alias(n) for n, c in counts.items())), seen


def load_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """First sight of a new key is an insert; known keys and repeats inside the batch are updates."""
    fresh = incoming.join(existing.select(*KEY), KEY, "left_anti").agg(F.count_distinct(*KEY).alias("inserted"))
    return fresh.join(incoming.agg(F.count("*").alias("n")), F.lit(True)).select("inserted", (F.col("n") - F.col("inserted")).alias("updated"))


def cleaned_skills(pairs: DataFrame, many: int = 0) -> DataFrame:
    """(job_id, name) with names trimmed and lower-cased, blanks and repeats dropped. many: how many pairs there are, where that is known; tasks of like size
    get them then."""
    return dealt(pairs.select("job_id", F.trim(F.lower("name")).alias("name")).filter("name <> ''"), many, "job_id", "name").distinct()


def new_skills(pairs: DataFrame, skills: DataFrame) -> DataFrame:
    """Names that the dimension lacks."""
    return cleaned_skills(pairs).select("name").distinct().join(skills.select(F.lower("name").alias("name")), "name", "left_anti")


def new_links(pairs: DataFrame, known: DataFrame, many: int = 0) -> DataFrame:
    """(job_id, name) pairs that the bridge lacks; many as in cleaned_skills()."""
    return cleaned_skills(pairs, many).join(known, ["job_id", "name"], "left_anti")


def purge(jobs: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Postings seen within the retention."""
    if not 30 <= days <= 365:
        raise ValueError("retention is 30 to 365 days")
    return jobs.filter(F.col("scraped_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))


def purge_links(links: DataFrame, kept: DataFrame) -> DataFrame:
    return links.join(kept.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def append_run(log: DataFrame, run: DataFrame) -> DataFrame:
    """The run log with further runs; ids go on from the largest, in the order of their start. Windows see the new runs only."""
    last = log.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("last"))
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("started_at", "source_site", "status"))
    new = run.withColumn("number", number).join(last, F.lit(True)).withColumn("run_id", F.col("last") + F.col("number"))
    return log.unionByName(new.select(*log.columns))


def run_durations(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "status", (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).alias("duration_seconds"))


def pipeline_metrics(stages: DataFrame) -> DataFrame:
    """One row from (stage, n): counts of the stages, what was loaded and the success rate."""
    names = ["extracted", "transformed", "enriched", "validated", "inserted", "updated", "failed", "purged", "skills", "relationships"]
    row = stages.groupBy().pivot("stage", names).agg(F.sum("n")).fillna(0)
    rate = F.when(F.col("extracted") == 0, 100.0).otherwise(F.col("validated") / F.col("extracted") * 100)
    return row.select(*(F.col(n).cast("long").alias(n) for n in names), (F.col("inserted") + F.col("updated")).cast("long").alias("total_loaded"), rate.alias("success_rate"))
