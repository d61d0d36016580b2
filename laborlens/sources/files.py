"""Sources and sinks: raw posting records, labelled sets, label exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.session import exists

LABELED = T.StructType([T.StructField(n, t) for n, t in (("title", T.StringType()), ("description", T.StringType()), ("is_tech_role", T.BooleanType()), ("expected_category", T.StringType()))])


def read_raw(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """One record of JSON text a line; _source_country from its partition directory, or as given."""
    rows = spark.read.option("basePath", path).text(path)
    named = rows.withColumnRenamed("value", "raw")
    return named if country is None else named.withColumn("_source_country", F.lit(country))


def read_labeled(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled rows of a CSV file with a header, or of JSON: a list, {"jobs": [...]} or an object a file, or of those
    one a line, which Spark can split."""
    if path.endswith(".csv"):
        return spark.read.schema(LABELED).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = spark.read.schema(T.StructType([*LABELED.fields, T.StructField("jobs", T.ArrayType(LABELED))])).option("multiLine", not lines).json(path)
    alone = rows.filter("jobs is null").select(*LABELED.names)
    return alone.unionByName(rows.select(F.explode("jobs").alias("j")).select("j.*"))


def read_terms(spark: SparkSession, path: str | None, built_in: list[str] = ()) -> DataFrame:
    """(term): a dictionary of skills from JSON files, each a list or {"skills": [...]}; in lower case, once each. Where nothing lies at path, or no file
    there holds such a list, the built-in terms."""
    clean = lambda rows: rows.select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    default = clean(spark.createDataFrame([(t,) for t in built_in], "term string"))
    if not path or not exists(spark, path):
        return default
    text = spark.read.text(path, wholetext=True)
    lists = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<skills: array<string>>")["skills"])
    found = text.select(lists.alias("terms")).filter("terms is not null")
    return default if found.isEmpty() else clean(found.select(F.explode("terms").alias("term")))


def squeezed(column: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))


def shortened(text: Column, limit: int = 2000) -> Column:
    """At most `limit` characters, cut at a word's end and marked."""
    head = F.substring(text, 1, limit)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(head, r"^(.*) ", 1), F.lit("")), head), F.lit("...")))


#: Columns of a label export, in their order.
EXPORT = [
    "id", "title", "company", "location", "country", "source", "posted_date", "skills", "classifier_prediction", "classifier_confidence", "classifier_ambiguity",
    "classifier_category", "classifier_score", "classifier_reason", "is_tech", "category", "difficulty", "notes", "description",
]


def label_export(posts: DataFrame) -> DataFrame:
    """The columns of a label export, all as text; what posts lack, and what labellers fill in (is_tech, category, difficulty, notes), is empty."""
    text = {"title": squeezed("title"), "description": shortened(squeezed("description")), "skills": F.array_join("skills", ", ") if "skills" in posts.columns else F.lit("")}
    blank = {"is_tech", "category", "difficulty", "notes"}
    return posts.select(*((F.lit("") if c in blank else text[c] if c in text else F.coalesce(F.col(c).cast("string"), F.lit("")) if c in posts.columns else F.lit("")).alias(c) for c in EXPORT))


def write_label_export(posts: DataFrame, path: str) -> None:
    label_export(posts).write.option("header", True).option("quoteAll", True).csv(path)
