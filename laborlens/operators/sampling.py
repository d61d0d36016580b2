"""Stratified sampling for labelling: allocation on group counts, then ranks inside strata. No rows are collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(id_col: str = "id", seed: int = 42) -> Column:
    """A repeatable random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def dedupe(rows: DataFrame) -> DataFrame:
    """The first row of each posting: by source and id, else by squeezed title, company and country."""
    squeezed = F.lower(F.trim(F.regexp_replace(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("company_name", F.lit("")), F.coalesce("country_code", F.lit(""))), r"\s+", " ")))
    key = F.when(F.col("source_site").isNotNull() & F.col("source_id").isNotNull(), F.concat_ws("|", "source_site", "source_id")).otherwise(squeezed)
    return rows.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter("rank = 1").drop("rank", "key")


def ambiguity_level(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.35, "medium").otherwise("low")


def allocate(counts: DataFrame, group: str, n: int, minimum: int = 0) -> DataFrame:
    """Seats for (group, count) by largest remainder: the minimum first, if there are seats for it in every group; floors of the
    proportional shares of the rest; one more for the largest remainders, then for the largest groups, where a group has more rows
    than seats. Equal remainders go to the larger group, equal sizes to the first name. The windows see one row a group."""
    all_ = Window.partitionBy(F.lit(1))
    kept = F.when(F.count("*").over(all_) * minimum <= n, F.lit(minimum)).otherwise(0)
    seats = counts.withColumn("kept", kept).withColumn("rest", F.lit(n) - F.sum("kept").over(all_))
    seats = seats.withColumn("exact", F.col("rest") * F.col("count") / F.sum("count").over(all_)).withColumn("base", F.col("kept") + F.floor("exact"))
    seats = seats.withColumn("left", F.lit(n) - F.sum("base").over(all_)).withColumn("open", (F.col("base") < F.col("count")).cast("int"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("open"), F.desc(F.round(F.col("exact") - F.floor("exact"), 9)), F.desc("count"), F.asc_nulls_first(group))
    seats = seats.withColumn("more", ((F.row_number().over(order) <= F.col("left")) & (F.col("open") == 1)).cast("int"))
    seats = seats.withColumn("last", F.col("left") - F.sum("more").over(all_)).withColumn("open", (F.col("base") + F.col("more") < F.col("count")).cast("int"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("open"), F.desc("count"), F.asc_nulls_first(group))
    most = ((F.row_number().over(order) <= F.col("last")) & (F.col("open") == 1)).cast("int")
    return seats.select(group, "count", (F.col("base") + F.col("more") + most).cast("long").alias("seats"))


def random_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(draw_order(seed=seed), "id").limit(n)


def stratified(rows: DataFrame, group: str, n: int, minimum: int = 0, seed: int = 42) -> DataFrame:
    """Each group's seats filled in draw order. The most seats of a group bound what each task keeps of a stratum before the rows are dealt."""
    seats = allocate(rows.groupBy(group).count(), group, n, minimum).select(F.col(group).alias("_group"), "seats")
    most = seats.agg(F.max("seats")).first()[0] or 0
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(draw_order(seed=seed), "id"))).filter(F.col("rank") <= most)
    return ranked.join(F.broadcast(seats), F.col(group).eqNullSafe(F.col("_group"))).filter("rank <= seats").select(*rows.columns)


def by_class(rows: DataFrame, flag: str, n: int, seed: int = 42) -> DataFrame:
    """Half of one class, the rest of the other."""
    yes = random_sample(rows.filter(F.col(flag)), n // 2, seed)
    return yes.unionByName(random_sample(rows.filter(~F.col(flag)), n - n // 2, seed))


def hybrid(rows: DataFrame, n: int, level: str = "level", flag: str = "is_tech", seed: int = 42) -> DataFrame:
    """30 % at random, 30 % of high ambiguity, 20 % of either class, once each; filled up at random to n."""
    parts = [
        random_sample(rows, int(n * 0.3), seed), random_sample(rows.filter(F.col(level) == "high"), int(n * 0.3), seed + 1),
        random_sample(rows.filter(F.col(flag)), int(n * 0.2), seed + 2), random_sample(rows.filter(~F.col(flag)), int(n * 0.2), seed + 3),
    ]
    chosen = parts[0].select("id")
    for p in parts[1:]:
        chosen = chosen.unionByName(p.select("id"))
    chosen = chosen.distinct().withColumn("picked", F.lit(0))
    ranked = rows.join(chosen, "id", "left").orderBy(F.asc_nulls_last("picked"), draw_order(seed=seed + 4), "id")
    return ranked.limit(n).select(*rows.columns)
