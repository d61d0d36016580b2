"""Balance of tech and other postings by country, targets for further acquisition and a balanced subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.05


def composition(jobs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Counts per country and, where is_total, over all; postings without a country are a country of their own, null."""
    out = jobs.withColumnRenamed("country_code", "country").rollup("country").agg(
        (F.grouping("country") == 1).alias("is_total"), F.count("*").alias("total"), F.count_if("is_tech_role").alias("tech"), F.count_if(~F.col("is_tech_role")).alias("non_tech"), F.count_if(F.col("is_tech_role").isNull()).alias("unclassified")
    )
    known = F.col("tech") + F.col("non_tech")
    ratio = F.when(known == 0, 0.0).otherwise(F.col("tech") / known)
    return out.select("*", ratio.alias("tech_ratio"), F.greatest(F.col("non_tech") - F.col("tech"), F.lit(0)).alias("deficit"), (F.abs(ratio - 0.5) <= tolerance).alias("parity"))


def targets(comp: DataFrame, cap: int = 100) -> DataFrame:
    """Mode and targets. Catching up, the deficit is met first; balanced, the cap is halved."""
    balanced = (F.col("tech") + F.col("non_tech") == 0) | F.col("parity")
    mode = F.when(balanced, "BALANCED").otherwise("CATCH_UP")
    tech = F.when(balanced, F.lit(cap // 2)).otherwise(F.least(F.col("deficit"), F.lit(cap)))
    return comp.select("country", "is_total", mode.alias("mode"), tech.cast("long").alias("tech_target"), (F.lit(cap) - tech).cast("long").alias("broad_target"))


def next_intent(comp: DataFrame, acquired: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """What to look for next, from the composition with what was acquired(country, got_tech, got_broad)."""
    held = acquired.withColumnRenamed("country", "_country")
    both = comp.filter("not is_total").join(held, F.col("country").eqNullSafe(F.col("_country")), "left").fillna(0, ["got_tech", "got_broad"])
    tech, known = F.col("tech") + F.col("got_tech"), F.col("tech") + F.col("non_tech") + F.col("got_tech") + F.col("got_broad")
    ratio = F.when(known == 0, 0.0).otherwise(tech / known)
    intent = F.when(ratio < 0.5 - tolerance, "tech").when(ratio > 0.5 + tolerance, "broad").when(F.col("got_tech") <= F.col("got_broad"), "tech").otherwise("broad")
    return both.select("country", ratio.alias("projected_ratio"), intent.alias("intent"))


def dedupe(pool: DataFrame) -> DataFrame:
    """Each candidate with its identity (id, else address, else a hash of title and company) and whether it is a repeat."""
    key = F.coalesce(F.col("source_id"), F.col("source_url"), F.md5(F.concat_ws("_", F.coalesce("title", F.lit("")), F.coalesce("company_name", F.lit("")))))
    keyed = pool.withColumn("identity", key)
    return keyed.withColumn("duplicate", F.row_number().over(Window.partitionBy("identity").orderBy("id")) > 1)


def select_balanced(pool: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates up to the targets of their country and class, smallest ids first. The largest target bounds what each task keeps."""
    most = wanted.agg(F.max(F.greatest("tech_target", "broad_target"))).first()[0] or 0
    ranked = pool.withColumn("place", F.row_number().over(Window.partitionBy("country_code", "is_tech_role").orderBy("id"))).filter(F.col("place") <= most)
    quota = F.when(F.col("is_tech_role"), F.col("tech_target")).otherwise(F.col("broad_target"))
    return ranked.join(wanted.filter("not is_total"), F.col("country_code").eqNullSafe(F.col("country"))).filter(F.col("place") <= quota).select(*pool.columns)


def query_metrics(acquired: DataFrame) -> DataFrame:
    """New, tech, other and unclassified postings per query and intent."""
    return acquired.groupBy("query", "intent").agg(F.count("*").alias("new"), F.count_if("is_tech_role").alias("tech"), F.count_if(~F.col("is_tech_role")).alias("non_tech"), F.count_if(F.col("is_tech_role").isNull()).alias("unclassified"))


def totals(comp: DataFrame) -> DataFrame:
    """Over all countries: sums, ratio and whether every country is at parity."""
    rows = comp.filter("not is_total").agg(F.count("*").alias("countries"), F.sum("tech").alias("tech"), F.sum("non_tech").alias("non_tech"), F.bool_and("parity").alias("all_at_parity"))
    return rows.withColumn("tech_ratio", F.when(F.col("tech") + F.col("non_tech") == 0, 0.0).otherwise(F.col("tech") / (F.col("tech") + F.col("non_tech"))))
