"""Corpus pipeline: each stage works on all that the one before it kept.

Counted as part of laborlens.llm and removed with it.

Rows without text, or with an empty one, pass all stages; rows whose id is null are kept as they are by the first four stages and
packed under a null id; rows that repeat an id are judged each by its own text, but near-duplicates by id; extra columns pass on; an
empty table gives no row; texts of any length are taken whole.

Whole rows go through Python in all stages but the second, so a batch's size in bytes is what executors hold outside the heap, for each core and on both
sides: stages lower the session's Arrow batches to BATCH_ROWS, which holds for what is written later, and leave lower ones.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laborlens.llm import decontam, near_dup, packing, secrets, toxicity
from laborlens.llm.common import crc_mod, stored, table

#: Rows of an Arrow batch; some 3 MB of the test texts, 33 MB with Spark's 10,000.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
            spark.conf.set(_ROWS, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from labelled rows that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=crc_mod("doc_id", 3) != 1)
    return toxicity.reject_toxic(docs, model)


@_in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest id stays."""
    return near_dup.keep_first(docs)


@_in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, or re-parameterised ones, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no document goes."""
    return secrets.redact_secrets(docs)


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", redact),
    ("packing", pack),
]

#: Classifier, hashing, expressions and tokens can't be expressed in SQL: tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
