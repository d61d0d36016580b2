"""Session helpers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors' Python, once an application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        out = tempfile.mkdtemp(prefix="spark-ship-")
        shutil.copytree(root, os.path.join(out, "in", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(out, root.name), "zip", os.path.join(out, "in")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files that gives fewer tasks than there are cores, dealt out again, for work that costs more than a shuffle of its input; others as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Rows that a task takes of what is dealt by dealt().
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, many: int, *keys: str, most: int | None = None) -> DataFrame:
    """Rows dealt by keys to tasks of some `most` (TASK_ROWS) of `many` rows, where the session's number of shuffle partitions would make them larger: what a task
    holds then doesn't grow with the input. Others as they are, for Spark to deal."""
    tasks = -(-many // (most or TASK_ROWS))
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where it is unset, a temporary one if all runs in one process,
    as in tests; several machines would not see each other's files there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors can reach")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: what follows in several branches is made once, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what lies at path, in whichever store that is."""
    place, store = _place(spark, path)
    store.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at path, which may be a pattern."""
    place, store = _place(spark, path)
    return bool(store.globStatus(place))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies right below path; none where it isn't there."""
    place, store = _place(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        drop_path(df.sparkSession, f.rsplit("/", 1)[0])
