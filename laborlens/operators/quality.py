"""Validation of postings: rules as columns, so that one pass gives what is kept and what is rejected and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold; a test on nulls doesn't."""
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def required_tests() -> dict[str, Column]:
    return {"source_id": blank("source_id"), "title": blank("title"), "company": blank("company_name")}


def both_given() -> Column:
    return F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull()


def field_tests() -> dict[str, Column]:
    return {
        "language": ~F.col("language").rlike("^[a-z]{2}$"),
        "country": ~F.col("country_code").rlike("^[A-Z]{2}$"),
        "currency": ~F.col("salary_currency").rlike("^[A-Z]{3}$"),
        "confidence": ~F.col("tech_confidence").between(0, 1),
        "salary": (F.col("salary_min") < 0) | (F.col("salary_max") < 0),
    }


def required(rows: DataFrame) -> DataFrame:
    return rows.withColumn("missing", reasons(required_tests()))


def salaries(rows: DataFrame) -> DataFrame:
    """Pay in ascending order with a warning where it was swapped; rejected where either amount is negative."""
    swap = both_given() & (F.col("salary_min") > F.col("salary_max"))
    return rows.withColumns(
        {
            "rejected": both_given() & ((F.col("salary_min") < 0) | (F.col("salary_max") < 0)),
            "warning": F.when(swap, "salary_swapped"),
            "salary_min": F.when(swap, F.col("salary_max")).otherwise(F.col("salary_min")),
            "salary_max": F.when(swap, F.col("salary_min")).otherwise(F.col("salary_max")),
        }
    )


def field_rules(rows: DataFrame) -> DataFrame:
    return rows.withColumn("broken", reasons(field_tests()))


def consistency(rows: DataFrame) -> DataFrame:
    """A tech posting has a category and a confidence, another one has neither, nor matched terms."""
    tech = F.col("is_tech_role") & (F.col("technology_category").isNull() | F.col("tech_confidence").isNull())
    other = ~F.col("is_tech_role") & (F.col("technology_category").isNotNull() | F.col("tech_confidence").isNotNull() | (F.coalesce(F.size("matched_terms"), F.lit(0)) > 0))
    return rows.withColumn("consistent", ~(tech | other))


def validate(rows: DataFrame, as_of: str) -> DataFrame:
    """valid, scraped_date filled and validated_at beside each row."""
    out = salaries(required(rows)).withColumn("valid", (F.size("missing") == 0) & ~F.coalesce("rejected", F.lit(False)))
    now = F.lit(as_of).cast("timestamp")
    return out.withColumns({"scraped_date": F.coalesce("scraped_date", now), "validated_at": now})


def batch_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("total"), F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("rejected"))


def strict_tests() -> dict[str, Column]:
    return required_tests() | {
        "salary_min": F.col("salary_min") < 0, "salary_max": F.col("salary_max") < 0, "salary_order": F.col("salary_min") > F.col("salary_max"), "url": ~F.col("source_url").rlike("^https?://[^ ]+$"),
    }


def strict_violations(rows: DataFrame) -> DataFrame:
    """One row for each rule that a row breaks under the strict rules."""
    return rows.select("id", F.explode(reasons(strict_tests())).alias("rule"))


class BatchRefused(ValueError):
    """A batch with rows that break the strict rules. broken: how many rows break each rule."""

    def __init__(self, broken: dict[str, int]):
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in sorted(broken.items())))
        self.broken = broken


def require_strict(rows: DataFrame) -> None:
    """Raises BatchRefused where any row breaks a strict rule; one aggregated pass."""
    counts = rows.agg(*(F.count_if(test).alias(rule) for rule, test in strict_tests().items())).first().asDict()
    if broken := {rule: n for rule, n in counts.items() if n}:
        raise BatchRefused(broken)


def constraint_violations(rows: DataFrame) -> DataFrame:
    """Rows that the tables' constraints refuse, and keys that occur more than once."""
    tests = {"confidence": ~F.col("tech_confidence").between(0, 1), "country_length": F.char_length("country_code") != 2, "currency_length": F.char_length("salary_currency") != 3}
    odd = rows.select(F.col("id").cast("string").alias("subject"), F.explode(reasons(tests)).alias("rule"))
    again = rows.groupBy("source_site", "source_id").count().filter("count > 1 and source_id is not null")
    return odd.unionByName(again.select(F.concat_ws(":", "source_site", "source_id").alias("subject"), F.lit("unique_key").alias("rule")))
