"""Raw posting records (JSON text) to normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First keyword that the contract type contains, in this order.
EMPLOYMENT_TYPES = (
    ("full", "FULL_TIME"), ("part", "PART_TIME"), ("contract", "CONTRACT"), ("intern", "INTERNSHIP"),
    ("temporary", "TEMPORARY"), ("temp", "TEMPORARY"), ("permanent", "PERMANENT"),
)


#: What acquisition notes on a record, each under its name after a low line.
ACQUISITION = ("acquisition_tech_intent", "acquisition_query", "acquisition_country", "acquisition_mode", "acquisition_batch")


#: Fields of a record, and as what they are read; what isn't of that kind is null. Variants are texts or nested objects.
FIELDS = ", ".join((
    "id string, title string, company variant, location variant, category variant, salary struct<min: double, max: double, currency: string>, salary_min double, salary_max double",
    "salary_currency string, contract_type string, type string, created string, description string, redirect_url string", *(f"_{name} string" for name in ACQUISITION),
))


def parsed(raw: str) -> Column:
    """All FIELDS of a record by one expression; null where it can't be read."""
    return F.try_variant_get(F.try_parse_json(raw), "$", f"struct<{FIELDS}>")


def field(path: str) -> Column:
    """A field of the parsed record; null where it isn't there or isn't of its kind."""
    return F.col(f"record.{path}")


def named(name: str, inner: str) -> Column:
    """A field of a nested object, or the scalar itself."""
    scalar = F.try_variant_get(field(name), "$", "string")
    return F.coalesce(F.try_variant_get(field(name), f"$.{inner}", "string"), F.when(~scalar.startswith("{"), scalar))


def shown_name(name: str) -> Column:
    """display_name of a nested object, or the scalar itself."""
    return named(name, "display_name")


def label(name: str) -> Column:
    """label of a nested object, or the scalar itself; empty where there is none."""
    return F.coalesce(named(name, "label"), F.lit(""))


def salary(end: str) -> Column:
    """Nested amount if it is a number, else the top-level one; anything else is null."""
    return F.coalesce(field(f"salary.{end}"), field(f"salary_{end}"))


def currency() -> Column:
    return F.coalesce(F.nullif(field("salary.currency"), F.lit("")), F.nullif(field("salary_currency"), F.lit("")))


def employment_type() -> Column:
    given = F.lower(F.coalesce(field("contract_type"), field("type")))
    out = F.when(F.lit(False), "")
    for word, kind in EMPLOYMENT_TYPES:
        out = out.when(given.contains(word), kind)
    return out.otherwise("OTHER")


def moment(name: str) -> Column:
    """ISO-8601 time or date, with or without fractions and offset; null where it can't be read."""
    return iso(field(name))


#: Times that Spark's cast reads as they are.
TOLD = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?)?$"


def iso(text: Column) -> Column:
    basic = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})($|[T ])", "$1-$2-$3$4")
    whole = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
    # what Spark's cast wants: a point, seconds, and offsets with a colon
    told = F.regexp_replace(F.regexp_replace(basic, ",", "."), r"([T ]\d{2})($|Z|[+-])", "$1:00$2")
    told = F.regexp_replace(told, r"([T ]\d{2}:\d{2})($|Z|[+-])", "$1:00$2")
    told = F.regexp_replace(F.regexp_replace(told, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    return F.when(text.rlike(TOLD), text.try_cast("timestamp")).when(basic.rlike(whole), told.try_cast("timestamp"))


def transform(raw: DataFrame, source: str, as_of: str) -> DataFrame:
    """One row for each record that has an id and a title; `as_of` stands in where a posting has no date. A record is parsed once: what comes out of a list
    of one isn't put in place of its uses, as a column would be, also in filters that move below joins."""
    out = raw.select("_source_country", F.explode(F.array(parsed("raw"))).alias("record")).select(
        field("id").alias("source_id"), F.lit(source).alias("source_site"), field("title").alias("title"), F.coalesce(shown_name("company"), F.lit("Unknown")).alias("company_name"),
        F.coalesce(shown_name("location"), F.lit("")).alias("location"), salary("min").alias("salary_min"), salary("max").alias("salary_max"), currency().alias("salary_currency"),
        employment_type().alias("employment_type"), moment("created").alias("posted_date"), F.col("_source_country").alias("source_country"),
        F.coalesce(field("description"), F.lit("")).alias("description"), F.coalesce(field("redirect_url"), F.lit("")).alias("source_url"), label("category").alias("category"), *(field(f"_{name}").alias(name) for name in ACQUISITION),
    )
    out = out.withColumn("scraped_date", F.coalesce("posted_date", F.lit(as_of).cast("timestamp")))
    return out.filter("source_id is not null and title is not null")
