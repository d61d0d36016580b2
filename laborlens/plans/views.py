"""The model's tables, made from the driver's tables; and the same as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.session import dealt, spread, table

#: What stands for the current time in every query.
AS_OF = "2001-08-01"


CONTRACTS = {"1-URGENT": "Full Time", "2-HIGH": "part-time", "3-MEDIUM": "Contractor", "5-LOW": "Internship"}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def jobs(self) -> DataFrame:
        pay = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        pay = pay.groupBy("l_orderkey").agg(F.min("l_extendedprice").cast("decimal(12,2)").alias("lo"), F.max("l_extendedprice").cast("decimal(12,2)").alias("hi"), F.max("p_type").alias("kind"))
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        rows = rows.join(pay, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        tech = F.col("o_custkey") % 2 == 0

        def by_region(*values: str):
            out = F.when(F.col("n_regionkey") == 0, values[0])
            for k, v in enumerate(values[1:], 1):
                out = out.when(F.col("n_regionkey") == k, v)
            return out

        return rows.select(
            F.col("o_orderkey").alias("id"), F.concat(F.coalesce("kind", F.lit("GENERAL")), F.lit(" "), F.col("o_orderpriority")).alias("title"), F.col("c_name").alias("company_name"),
            F.col("n_name").alias("location"), F.col("n_name").alias("country_code"), F.col("c_mktsegment").alias("source_site"), F.col("o_orderkey").cast("string").alias("source_id"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("employment_type"), F.col("o_orderdate").alias("posted_date"), F.col("o_orderdate").alias("scraped_date"),
            (F.col("o_orderstatus") != "F").alias("is_active"), (F.col("o_orderkey") % 50 == 0).alias("is_deleted"), F.col("lo").alias("salary_min"), F.col("hi").alias("salary_max"),
            by_region("USD", "EUR", "GBP", "CAD").alias("salary_currency"), by_region("en", "de", "fr", "es").alias("language"), tech.alias("is_tech_role"), F.when(tech, F.col("kind")).alias("technology_category"),
        )

    @cached_property
    def skills(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("name"))

    @cached_property
    def links(self) -> DataFrame:
        pairs = self.table("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))
        return dealt(pairs, self.many_links, "job_id", "skill_id").distinct()

    @cached_property
    def many_links(self) -> int:
        """Links and their repeats, from the files' footers."""
        return self.table("lineitem").count()

    @cached_property
    def runs(self) -> DataFrame:
        e = self.table("events")
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("completed")
        done = F.when(status != "running", F.timestamp_seconds(F.unix_timestamp("ts") + F.floor(F.coalesce("value", F.lit(0.0)))))
        return e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), done.alias("completed_at"), status.alias("status"), F.floor("value").cast("int").alias("records_processed"), F.col("event_type").alias("source_site"))

    @cached_property
    def requests(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.coalesce("value", F.lit(0.0)).alias("duration_ms"))

    @property
    def raw(self) -> DataFrame:
        """Raw posting records as JSON text, in all the shapes that the source sends."""
        return self.records.select("_source_country", "raw")

    @cached_property
    def again(self) -> DataFrame:
        """Later records of some keys, with other titles."""
        return self.records.filter("id % 19 = 0").withColumn("raw", F.replace("raw", F.lit('"title":"'), F.lit('"title":"again ')))

    @cached_property
    def feed(self) -> DataFrame:
        """Records and later ones of some keys; some without a title, some with negative pay."""
        rows = self.records.unionByName(self.again)
        odd = F.when(F.col("id") % 17 == 0, F.replace("raw", F.lit('"title":'), F.lit('"headline":'))).otherwise(F.col("raw"))
        return rows.select("_source_country", F.when(F.col("id") % 13 == 0, F.replace(odd, F.lit('"salary_min":'), F.lit('"salary_min":-'))).otherwise(odd).alias("raw"))

    @cached_property
    def records(self) -> DataFrame:
        j = self.jobs.filter("salary_min is not null")
        k = lambda n: F.col("id") % n
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        shown = lambda c: F.concat(F.lit('{"display_name":"'), c, F.lit('"}'))
        lo, hi = F.col("salary_min").cast("string"), F.col("salary_max").cast("string")
        company = F.when(k(3) == 0, F.concat(F.lit(',"company":'), quoted("company_name"))).when(k(3) == 1, F.concat(F.lit(',"company":'), shown(F.col("company_name")))).otherwise("")
        place = F.concat(F.lit(',"location":'), F.when(k(2) == 0, shown(F.col("location"))).otherwise(quoted("location")))
        top = F.concat(F.lit(',"salary_min":'), lo, F.lit(',"salary_max":'), hi, F.lit(',"salary_currency":"GBP"'))
        pay = F.when(k(4) == 0, F.concat(F.lit(',"salary":{"min":'), lo, F.lit(',"max":'), hi, F.lit(',"currency":"EUR"}'))).when(k(4) == 1, top)
        pay = pay.when(k(4) == 2, F.concat(F.lit(',"salary":{"min":"abc","max":null,"currency":""}'), top)).otherwise("")
        kinds = F.create_map(*(F.lit(x) for pair in CONTRACTS.items() for x in pair))
        contract = F.coalesce(F.concat(F.lit(',"contract_type":"'), kinds[F.col("employment_type")], F.lit('"')), F.lit(',"type":"Perm. (permanent)"'))
        shapes = {1: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", 2: "yyyy-MM-dd", 3: "yyyy-MM-dd'T'HH:mm:ss'+02:00'", 4: "yyyy-MM-dd HH:mm:ss", 5: "yyyyMMdd", 6: "yyyy-MM-dd'T'HH:mm'-0530'"}
        when = F.when(k(10) == 0, "soon")
        for digit, shape in shapes.items():
            when = when.when(k(10) == digit, F.date_format("posted_date", shape))
        when = when.otherwise(F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        record = F.concat(F.lit('{"id":'), "source_id", F.lit(',"title":'), quoted("title"), company, place, pay, contract, F.lit(',"created":"'), when, F.lit('","category":'), F.when(k(2) == 0, F.concat(F.lit('{"label":"'), "source_site", F.lit('"}'))).otherwise(quoted("source_site")), F.lit(',"redirect_url":"https://example.com/'), "source_id", F.lit('","_acquisition_query":'), quoted("source_site"), F.lit("}"))
        return j.select("id", F.col("country_code").alias("_source_country"), record.alias("raw"))

    @cached_property
    def drafts(self) -> DataFrame:
        """Postings before validation, some of them wrong in every way that the rules know."""
        k = lambda n: F.col("id") % n == 0
        lo, hi = F.col("salary_min"), F.col("salary_max")
        return self.jobs.select(
            "id", F.when(~k(17), F.col("source_id")).alias("source_id"), F.when(k(7), F.lit("  ")).otherwise(F.col("title")).alias("title"), F.when(~k(11), F.col("company_name")).alias("company_name"),
            F.when(k(13), -lo).when(k(5), hi).otherwise(lo).alias("salary_min"), F.when(k(5), lo).when(k(23), None).otherwise(hi).alias("salary_max"),
            F.when(k(6), F.upper("language")).otherwise(F.col("language")).alias("language"), F.substring("country_code", 1, 2).alias("country_code"), F.when(k(9), F.lower("salary_currency")).otherwise(F.col("salary_currency")).alias("salary_currency"),
            F.when(k(19), 1.5).when(F.col("is_tech_role") | k(10), (F.col("id") % 100) / 100.0).alias("tech_confidence"), "is_tech_role", F.when(F.col("is_tech_role") | k(21), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("matched_terms"), F.when(~k(8), F.col("technology_category")).alias("technology_category"),
            F.when(~k(3), F.col("scraped_date")).alias("scraped_date"), F.when(k(29), "no url").otherwise("https://example.com/job").alias("source_url"), "source_site",
        )

    @cached_property
    def existing(self) -> DataFrame:
        told = {"description": F.concat(F.lit("about "), "title"), "source_url": F.concat(F.lit("https://example.com/"), "source_id")}
        return self.jobs.filter("id % 3 <> 0").withColumns(told)

    @cached_property
    def incoming(self) -> DataFrame:
        """A batch: even ids with new pay, some in another language; of every fourth id a second record that came later."""
        k = lambda n: F.col("id") % n == 0
        told = {
            "salary_min": (F.col("salary_min") + 1000).cast("decimal(12,2)"), "language": F.when(k(8), "xx").otherwise(F.col("language")), "description": F.when(~k(6), F.lit("more")),
            "source_url": F.when(~k(10), F.concat(F.lit("https://example.org/"), "source_id")), "company_name": F.when(~k(14), F.col("company_name")), "arrival": F.lit(1),
        }
        once = self.jobs.filter("id % 2 = 0").withColumns(told)
        later = once.filter("id % 4 = 0").withColumn("title", F.lit("second")).withColumn("arrival", F.lit(2))
        return once.unionByName(later)

    @cached_property
    def posts(self) -> DataFrame:
        """Text postings."""
        d = spread(self.table("documents").select("doc_id", "text", "lang", "source"))
        return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), F.col("lang").alias("language"), F.col("source").alias("source_site"))


JOBS = """
pay AS (SELECT l_orderkey, CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS lo, CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS hi, max(p_type) AS kind
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
jobs AS (SELECT o_orderkey AS id, coalesce(kind, 'GENERAL') || ' ' || o_orderpriority AS title, c_name AS company_name, n_name AS location, n_name AS country_code, c_mktsegment AS source_site,
                CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS employment_type,
                o_orderdate AS posted_date, o_orderdate AS scraped_date, o_orderstatus <> 'F' AS is_active, o_orderkey % 50 = 0 AS is_deleted,
                lo AS salary_min, hi AS salary_max, CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CAD' END AS salary_currency,
                CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' END AS language,
                o_custkey % 2 = 0 AS is_tech_role, CASE WHEN o_custkey % 2 = 0 THEN kind END AS technology_category
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN pay ON o_orderkey = l_orderkey),
act AS (SELECT * FROM jobs WHERE is_active AND NOT is_deleted),
skills AS (SELECT p_partkey AS skill_id, p_name AS name FROM part),
links AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill_id FROM lineitem)
"""
RUNS = """
runs AS (SELECT event_id AS run_id, ts AS started_at, event_type AS source_site, CAST(floor(value) AS INTEGER) AS records_processed,
                CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status,
                CASE WHEN event_type <> 'view' THEN to_timestamp(floor(epoch(ts)) + floor(coalesce(value, 0))) END AS completed_at FROM events)
"""

DRAFTS = """
drafts AS (SELECT id, CASE WHEN id % 17 <> 0 THEN source_id END AS source_id, CASE WHEN id % 7 = 0 THEN '  ' ELSE title END AS title, CASE WHEN id % 11 <> 0 THEN company_name END AS company_name,
  CASE WHEN id % 13 = 0 THEN -salary_min WHEN id % 5 = 0 THEN salary_max ELSE salary_min END AS salary_min, CASE WHEN id % 5 = 0 THEN salary_min WHEN id % 23 = 0 THEN NULL ELSE salary_max END AS salary_max,
  CASE WHEN id % 6 = 0 THEN upper(language) ELSE language END AS language, substr(country_code, 1, 2) AS country_code, CASE WHEN id % 9 = 0 THEN lower(salary_currency) ELSE salary_currency END AS salary_currency,
  CASE WHEN id % 19 = 0 THEN 1.5 WHEN is_tech_role OR id % 10 = 0 THEN (id % 100) / 100.0 END AS tech_confidence, is_tech_role, CASE WHEN is_tech_role OR id % 21 = 0 THEN ['x'] ELSE [] END AS matched_terms, CASE WHEN id % 8 <> 0 THEN technology_category END AS technology_category,
  CASE WHEN id % 3 <> 0 THEN scraped_date END AS scraped_date, CASE WHEN id % 29 = 0 THEN 'no url' ELSE 'https://example.com/job' END AS source_url, source_site FROM jobs)
"""
BATCH = """
existing AS (SELECT *, 'about ' || title AS description, 'https://example.com/' || source_id AS source_url FROM jobs WHERE id % 3 <> 0),
once AS (SELECT * REPLACE (CAST(salary_min + 1000 AS DECIMAL(12,2)) AS salary_min, CASE WHEN id % 8 = 0 THEN 'xx' ELSE language END AS language, CASE WHEN id % 14 <> 0 THEN company_name END AS company_name),
  CASE WHEN id % 6 <> 0 THEN 'more' END AS description, CASE WHEN id % 10 <> 0 THEN 'https://example.org/' || source_id END AS source_url, 1 AS arrival FROM jobs WHERE id % 2 = 0),
incoming AS (SELECT * FROM once UNION ALL SELECT * REPLACE ('second' AS title, 2 AS arrival) FROM once WHERE id % 4 = 0)
"""
