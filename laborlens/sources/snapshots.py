"""A table of postings in versioned snapshots of Parquet files, for loads that touch a part of it.

A posting's bucket follows from its key, and every bucket lies in a folder of its own. A batch rewrites the buckets that its keys fall
into, to new folders, and then publishes a manifest that names the folder of every bucket: the old one where nothing came in, whose files are
left as they are. Readers take one manifest, the newest that was committed, so they see a batch whole or not at all. A manifest holds the
number of its batch: a batch that was loaded before changes nothing. As a bucket is rewritten whole, it never falls into small files;
vacuum() deletes the folders that only older versions name.

What the driver holds is the manifest: one row for each bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.operators import load
from laborlens.operators.quality import require_strict
from laborlens.session import drop_path, drop_stored, list_names, stored

BUCKETS = 64


@dataclass(frozen=True)
class Version:
    number: int = 0
    batch: int = -1
    buckets: int = BUCKETS
    #: bucket -> folder below the table's path
    folders: dict[int, str] = field(default_factory=dict)
    #: What the batch of this version did; nothing where it had been loaded before.
    counts: dict[str, int] = field(default_factory=dict)


def _manifest(path: str, number: int) -> str:
    return f"{path}/versions/{number:09d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    return sorted(int(n) for n in list_names(spark, f"{path}/versions") if n.isdigit() and "_SUCCESS" in list_names(spark, f"{path}/versions/{n}"))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or the one named."""
    known = versions(spark, path)
    if not known:
        return Version()
    rows = spark.read.schema("number int, batch long, buckets int, bucket int, folder string").json(_manifest(path, known[-1] if number is None else number)).collect()
    return Version(rows[0].number, rows[0].batch, rows[0].buckets, {r.bucket: r.folder for r in rows if r.bucket is not None})


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*load.KEY), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def latest(spark: SparkSession, path: str, schema, number: int | None = None) -> DataFrame:
    """The postings of one version."""
    return _read(spark, path, list(current(spark, path, number).folders.values()), schema)


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    rows = [(version.number, version.batch, version.buckets, b, f) for b, f in sorted(version.folders.items())] or [(version.number, version.batch, version.buckets, None, None)]
    spark.createDataFrame(rows, "number int, batch long, buckets int, bucket int, folder string").coalesce(1).write.mode("errorifexists").json(_manifest(path, version.number))


def _write(rows: DataFrame, path: str, buckets: int) -> str:
    """Rows in folders by bucket; the name of the folder above them."""
    name = f"data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
    return name


def create(spark: SparkSession, path: str, rows: DataFrame, buckets: int = BUCKETS) -> Version:
    """A new table of rows with the columns of load.posting_schema(), one for each key."""
    name = _write(rows, path, buckets)
    held = {int(n.split("=")[1]): f"{name}/{n}" for n in list_names(spark, f"{path}/{name}") if n.startswith("bucket=")}
    after = Version(1, -1, buckets, held, {"inserted": rows.count(), "updated": 0})
    _publish(spark, path, after)
    return after


def merge(spark: SparkSession, path: str, incoming: DataFrame, as_of: str, batch: int | None = None, buckets: int = BUCKETS, strict: bool = False) -> Version:
    """Upserts a batch of postings, the last arrival of each key, and gives the new version with what was inserted and updated. strict: a
    posting that breaks the strict rules fails the batch before anything is written to the table."""
    before = current(spark, path)
    if batch is not None and batch <= before.batch:
        return before
    buckets = before.buckets if before.folders else buckets
    came = stored(incoming.withColumn("bucket", bucket_of(buckets)), "batch")
    if strict:
        require_strict(came)
    touched = [r.bucket for r in came.select("bucket").distinct().collect()]
    last = load.last_per_key(came).drop("bucket", "arrival") if "arrival" in came.columns else came.drop("bucket")
    old = _read(spark, path, [before.folders[b] for b in touched if b in before.folders], load.posting_schema(last))
    counted, observed = load.observed(load.upsert(old, last, as_of, flag="fresh"), "upsert", inserted=F.count_if("fresh"))
    name = _write(counted.drop("fresh"), path, buckets)
    fresh = load.counted(observed, "inserted")
    folders = before.folders | {b: f"{name}/bucket={b}" for b in touched}
    after = Version(before.number + 1, before.batch if batch is None else batch, buckets, folders, {"inserted": fresh, "updated": came.count() - fresh})
    _publish(spark, path, after)
    drop_stored(came)
    return after


def purge(spark: SparkSession, path: str, schema, as_of: str, days: int = 90) -> Version:
    """Drops postings seen before the retention; only buckets that hold such are rewritten."""
    before = current(spark, path)
    rows = latest(spark, path, schema)
    gone = rows.join(load.purge(rows, as_of, days).select(*load.KEY), load.KEY, "left_anti").withColumn("bucket", bucket_of(before.buckets))
    n = {r.bucket: r["n"] for r in gone.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Version(before.number, before.batch, before.buckets, before.folders, {"purged": 0})
    kept = stored(load.purge(_read(spark, path, [before.folders[b] for b in n], schema), as_of, days), "kept")
    left = [r[0] for r in kept.select(bucket_of(before.buckets)).distinct().collect()]
    name = _write(kept, path, before.buckets)
    folders = {b: f for b, f in before.folders.items() if b not in n} | {b: f"{name}/bucket={b}" for b in left}
    after = Version(before.number + 1, before.batch, before.buckets, folders, {"purged": sum(n.values())})
    _publish(spark, path, after)
    drop_stored(kept)
    return after


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes older versions than the newest `keep`, and the folders that none of those names; the number of folders deleted."""
    known = versions(spark, path)
    held = {f.split("/")[1] for n in known[-keep:] for f in current(spark, path, n).folders.values()}
    for n in known[:-keep]:
        drop_path(spark, _manifest(path, n))
    gone = [d for d in list_names(spark, f"{path}/data") if d not in held] if known else []
    for d in gone:
        drop_path(spark, f"{path}/data/{d}")
    return len(gone)
