"""All registered queries of the engine: name -> (builder over Views, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from laborlens.plans.views import Views

MODULES = ("analytics_queries", "load_queries", "label_queries", "class_queries", "enrich_queries")


def entries() -> dict[str, tuple[Callable[[Views], DataFrame], str | None]]:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"laborlens.plans.{name}").ENTRIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Views(spark, sf_dir))

    return {name: bound(build) for name, (build, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql}
