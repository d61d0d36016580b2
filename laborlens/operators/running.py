"""Running sums and medians that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.session import stored

#: Ranges that the values are cut into, at approximate quantiles.
RANGES = 256


def with_running_sums(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """rows with upto_<column>: the column's sum over all rows whose `by`, a number that no two rows share, is not larger. Each task sorts one
    range of values; one window sees the ranges' totals, RANGES at most."""
    edges = sorted(set(rows.select(F.col(by).cast("double").alias(by)).approxQuantile(by, [k / RANGES for k in range(1, RANGES)], 0.5 / RANGES)))
    place = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col(by).cast("double"))) if edges else F.lit(0)
    cut = rows.withColumn("_range", place)
    totals = cut.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, "_range").select(*rows.columns, *((F.col(f"_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in columns))
    return out


def median(rows: DataFrame, value: Column) -> DataFrame:
    """One row, median: the exact middle of the values that aren't null, null if there are none. Equal values are counted first."""
    counts = stored(rows.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n")), "values")
    upto = with_running_sums(counts, "v", ["n"])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    middle = upto.join(total, F.lit(True)).filter("upto_n >= (total + 1) div 2 and upto_n - n < total div 2 + 1")
    # the lower and the upper middle are the first value that reaches them
    return middle.agg(((F.min("v") + F.max("v")) / 2).alias("median"))
