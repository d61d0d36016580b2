"""Incremental loading with Structured Streaming. Each run takes what is new and ends (availableNow)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.operators import enrich, load, quality
from laborlens.operators.transform import transform
from laborlens.session import drop_stored, list_names, stored
from laborlens.sources import snapshots


def raw_stream(spark: SparkSession, path: str, country: str) -> DataFrame:
    return spark.readStream.text(path).select(F.col("value").alias("raw"), F.lit(country).alias("_source_country"))


@dataclass(frozen=True)
class Dictionaries:
    """What enrichment looks up; DataFrames all but the last two."""

    profile: DataFrame
    terms: DataFrame
    keywords: DataFrame
    negatives: DataFrame
    categories: DataFrame
    aliases: DataFrame | None = None
    lexicon: DataFrame | None = None
    most_skills: int = enrich.MOST_SKILLS
    retention: int = 90


def load_batch(raw: DataFrame, path: str, source: str, as_of: str, known: Dictionaries, batch: int | None = None, strict: bool = False) -> dict[str, int]:
    """Transforms, enriches, validates and upserts a batch of raw records into the tables below path, then purges what is older than the retention.
    Gives the counts of the stages, each taken as the rows pass. Of a key that comes twice, the record that arrives last wins. A batch that was
    loaded before changes nothing and counts nothing. A skill or a link is new if no earlier batch brought it."""
    spark = raw.sparkSession
    before = snapshots.current(spark, f"{path}/jobs")
    if batch is not None and batch <= before.batch:
        return {}
    number = before.batch + 1 if batch is None else batch
    came, extracted = load.observed(raw, "extracted", n=F.count("*"))
    rows, transformed = load.observed(transform(came, source, as_of), "transformed", n=F.count("*"))
    # the order of files and lines is that of arrival; it also tells records with one key apart until they are merged
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "transformed")
    posts = rows.withColumnRenamed("category", "source_category").withColumns({"currency": F.col("salary_currency"), "amount": F.col("salary_min")})
    done = enrich.enrich_postings(posts, known.profile, known.terms, known.keywords, known.negatives, known.categories, known.aliases, known.lexicon, known.most_skills)
    done, enriched = load.observed(done, "enriched", n=F.count("*"))
    checked = quality.validate(done, as_of).filter("valid")
    valid, validated = load.observed(checked, "validated", n=F.count("*"))
    job = valid.select(
        F.xxhash64(*load.KEY).alias("id"), *load.KEY, "title", "description", "company_name", "location", "salary_min", "salary_max", "salary_currency", "source_url", "posted_date", F.col("detected").alias("language"),
        F.col("category").alias("technology_category"), F.col("is_tech").alias("is_tech_role"), "tech_confidence", F.col("country").alias("country_code"), "employment_type", "skills", F.col("id").alias("arrival"),
    )
    jobs = stored(job, "validated")
    merged = snapshots.merge(spark, f"{path}/jobs", jobs.drop("skills"), as_of, number, strict=strict)
    schema = load.posting_schema(jobs.drop("skills", "arrival"))
    purged = snapshots.purge(spark, f"{path}/jobs", schema, as_of, known.retention)
    pairs = load.last_per_key(jobs).select(F.col("id").alias("job_id"), F.explode("skills").alias("name"))
    skills, links = (_appended(spark, f"{path}/{n}", number, schema, fresh) for n, schema, fresh in (
        ("skills", "name string", lambda old: load.new_skills(pairs, old)), ("links", "job_id long, name string", lambda old: load.new_links(pairs, old))))
    counts = {n: load.counted(seen, "n") for n, seen in (("extracted", extracted), ("transformed", transformed), ("enriched", enriched), ("validated", validated))}
    for df in (rows, jobs):
        drop_stored(df)
    return counts | {"failed": counts["extracted"] - counts["validated"]} | merged.counts | purged.counts | {"skills": skills, "relationships": links}


def _appended(spark: SparkSession, path: str, number: int, schema: str, fresh: Callable[[DataFrame], DataFrame]) -> int:
    """Writes what a batch adds to a table that only grows, and counts it. Doing it again replaces the same folder."""
    earlier = [f"{path}/batch={n:09d}" for n in sorted(int(x.split("=")[1]) for x in list_names(spark, path) if x.startswith("batch=")) if n < number]
    old = spark.read.schema(schema).parquet(*earlier) if earlier else spark.createDataFrame([], schema)
    rows, seen = load.observed(fresh(old), "appended", n=F.count("*"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")
    return load.counted(seen, "n")


def ingest(spark: SparkSession, landing: str, path: str, checkpoint: str, source: str, country: str, as_of: str, known: Dictionaries) -> list[dict[str, int]]:
    """New files of the landing folder, loaded with load_batch(); the counts of each batch. A batch that Spark repeats after a failure is known by its number."""
    told: list[dict[str, int]] = []

    def load_it(batch: DataFrame, number: int) -> None:
        told.append(load_batch(batch, path, source, as_of, known, number))

    raw_stream(spark, landing, country).writeStream.foreachBatch(load_it).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return told


def once_per_key(events: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """A stream's first row of each key within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, time: str, delay: str = "40 days") -> DataFrame:
    """Rows a day; late rows within the delay are counted in."""
    return events.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("day"), "count")


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream to its end and gives what it wrote; complete mode keeps the last batch's whole result."""

    def load(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
