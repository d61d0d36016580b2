"""Registered queries of enrichment, sources and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import dims as D
from laborlens.operators import enrich as E
from laborlens.sources import files, snapshots
from laborlens.session import shared_dir
from laborlens.streaming import ingest
from laborlens.plans.class_queries import FINAL
from laborlens.plans.load_queries import COMPANY, CURRENCY, HELD, KIND, PAID, RAW, _known
from laborlens.plans.views import AS_OF, JOBS, Views

WITH = "WITH " + JOBS
WORD = r"[^\p{L}\p{N}\p{M}_]"
POSTS = "posts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description, lang AS language, source AS source_site FROM documents)"
CLEAN = r"trim(regexp_replace(regexp_replace(title || ' ' || description, '(?i)\s*[\(\[]\s*[mwdfx](\s*[/|]\s*[mwdfx])+\s*[\)\]]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Skills of the test texts: word -> shown name, canonical term, category.
SKILLS = {"the": "The", "and": "AND", "der": "Der", "una": "Una", "avec": "Avec", "thing": "Thing", "license": "License", "idiot": "Idiot", "apache license": "Apache License", "version 2.0": "Version 2.0", "(c)": "(C)"}
LEXICON = [("the", "the", "article"), ("der", "the", "article"), ("les", "the", "article"), ("and", "and", "conjunction"), ("und", "and", "conjunction"), ("software", "software", None), ("license", "license", "law"), ("licensed", "license", "law"), ("apache license", "apache", "law"), ("version 2.0", "version", None)]


def _shared(v: Views, what: str) -> str:
    return f"{shared_dir(v.spark)}/{what}-{uuid.uuid4().hex}"


_LO, _HI = "CAST(salary_min AS VARCHAR)", "CAST(salary_max AS VARCHAR)"
_TOP = f"',\"salary_min\":' || {_LO} || ',\"salary_max\":' || {_HI} || ',\"salary_currency\":\"GBP\"'"
_SHAPES = {1: "%Y-%m-%dT%H:%M:%S.000Z", 2: "%Y-%m-%d", 3: "%Y-%m-%dT%H:%M:%S+02:00", 4: "%Y-%m-%d %H:%M:%S", 5: "%Y%m%d", 6: "%Y-%m-%dT%H:%M-0530"}
RECORDS = f"""records AS (SELECT '{{"id":' || source_id || ',"title":"' || title || '"'
  || CASE id % 3 WHEN 0 THEN ',"company":"' || company_name || '"' WHEN 1 THEN ',"company":{{"display_name":"' || company_name || '"}}' ELSE '' END
  || ',"location":' || CASE WHEN id % 2 = 0 THEN '{{"display_name":"' || location || '"}}' ELSE '"' || location || '"' END
  || CASE id % 4 WHEN 0 THEN ',"salary":{{"min":' || {_LO} || ',"max":' || {_HI} || ',"currency":"EUR"}}' WHEN 1 THEN {_TOP} WHEN 2 THEN ',"salary":{{"min":"abc","max":null,"currency":""}}' || {_TOP} ELSE '' END
  || CASE employment_type WHEN '1-URGENT' THEN ',"contract_type":"Full Time"' WHEN '2-HIGH' THEN ',"contract_type":"part-time"' WHEN '3-MEDIUM' THEN ',"contract_type":"Contractor"' WHEN '5-LOW' THEN ',"contract_type":"Internship"' ELSE ',"type":"Perm. (permanent)"' END
  || ',"created":"' || CASE id % 10 WHEN 0 THEN 'soon' {' '.join(f"WHEN {k} THEN strftime(posted_date, '{shape}')" for k, shape in _SHAPES.items())} ELSE strftime(posted_date, '%Y-%m-%dT%H:%M:%SZ') END || '","category":' || CASE WHEN id % 2 = 0 THEN '{{"label":"' || source_site || '"}}' ELSE '"' || source_site || '"' END
  || ',"redirect_url":"https://example.com/' || source_id || '","_acquisition_query":"' || source_site || '"}}' AS raw FROM jobs WHERE salary_min IS NOT NULL)"""


def _texts(v: Views) -> DataFrame:
    return v.posts.select("id", F.concat_ws(" ", "title", "description").alias("text"))


def _landed(v: Views) -> str:
    path = _shared(v, "landing")
    v.raw.select("raw").write.text(path)
    return path


def _ingested(v: Views) -> DataFrame:
    """Two runs over one landing folder: all records, then later ones of some keys."""
    landing, path, checkpoint, known = _landed(v), _shared(v, "star"), _shared(v, "checkpoint"), _known(v)
    for more in (False, True):
        if more:
            v.again.select("raw").write.mode("append").text(landing)
        ingest.ingest(v.spark, landing, path, checkpoint, "feed", "xx", AS_OF, known)
    rows = snapshots.latest(v.spark, f"{path}/jobs", "source_id string, title string, company_name string, location string, salary_min double, salary_max double, salary_currency string, employment_type string, is_active boolean")
    return rows.select("source_id", "title", "company_name", "location", "salary_min", "salary_max", "salary_currency", "employment_type", "is_active")


def _stream(v: Views, df: DataFrame) -> DataFrame:
    path = _shared(v, "events")
    df.write.parquet(path)
    return v.spark.readStream.schema(df.schema).parquet(path)


def _daily(v: Views) -> DataFrame:
    out = ingest.run_to_table(v.spark, ingest.daily_counts(_stream(v, v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))), "ts"), _shared(v, "daily"), _shared(v, "checkpoint"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "count")


def _once(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return ingest.run_to_table(v.spark, ingest.once_per_key(_stream(v, e.unionByName(e)), "event_id", "ts", "40 days"), _shared(v, "once"), _shared(v, "checkpoint"), "append").select("event_id", "user_id")


def _dictionary(v: Views) -> DataFrame:
    """Skills of one maker a file, some as a list and some in an object; a path without files gives the built-in terms."""
    path = _shared(v, "terms")
    made = v.table("part").groupBy("p_brand").agg(F.collect_list("p_name").alias("skills"))
    listed = F.col("p_brand").endswith("1")
    made.filter(listed).select(F.to_json("skills")).write.option("maxRecordsPerFile", 1).text(path)
    made.filter(~listed).select(F.to_json(F.struct("skills"))).write.option("maxRecordsPerFile", 1).mode("append").text(path)
    return files.read_terms(v.spark, path).unionByName(files.read_terms(v.spark, f"{path}-none", ["Built In"]))


def _labeled(v: Views) -> DataFrame:
    path = _shared(v, "labeled")
    rows = v.posts.select("title", "description", (F.col("id") % 2 == 0).alias("is_tech_role"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("expected_category"))
    wrapped = rows.filter("is_tech_role").select(F.array(F.struct("*")).alias("jobs"))
    rows.filter("not is_tech_role").write.json(path)
    wrapped.write.mode("append").json(path)
    return files.read_labeled(v.spark, path, lines=True).groupBy("is_tech_role", "expected_category").agg(F.count("*").alias("count"), F.sum(F.char_length("description")).alias("chars"))


def _exported(v: Views) -> DataFrame:
    path = _shared(v, "export")
    posts = v.posts.withColumns({"source": F.col("source_site"), "country": F.col("language"), "skills": F.array("language", "source_site"), "classifier_score": F.col("id") / 4, "is_tech": F.lit(True)})
    files.write_label_export(posts, path)
    back = v.spark.read.option("header", True).csv(path, schema=", ".join(f"{c} string" for c in files.EXPORT)).fillna("")
    return back.select(F.col("id").cast("long").alias("id"), "title", F.md5("description").alias("digest"), "country", "source", "skills", F.col("classifier_score").cast("double").alias("classifier_score"), "is_tech", "notes")


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _case(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in values.items()) + " END"


NAMES = ["China", "India", "Germany", "United Kingdom", "Brazil", "Canada", "Japan"]
NAME = f"[{', '.join(repr(n) for n in NAMES)}][1 + id % {len(NAMES)}]"
PLACE = f"CASE id % 9 WHEN 0 THEN {NAME} WHEN 1 THEN 'Some City, ' || {NAME} WHEN 2 THEN 'Town (us)' WHEN 3 THEN 'Town [uk]' WHEN 4 THEN 'City,  us' WHEN 5 THEN 'Nowhere, na' WHEN 6 THEN 'Place (zz)' WHEN 7 THEN upper({NAME}) || ' ' ELSE country_code END"


def _places(v: Views) -> DataFrame:
    name, k = F.array(*map(F.lit, NAMES))[F.col("id") % len(NAMES)], F.col("id") % 9
    shapes = [name, F.concat(F.lit("Some City, "), name), F.lit("Town (us)"), F.lit("Town [uk]"), F.lit("City,  us"), F.lit("Nowhere, na"), F.lit("Place (zz)"), F.concat(F.upper(name), F.lit(" "))]
    place = F.when(k == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        place = place.when(k == i, shape)
    given = F.when(F.col("id") % 5 == 0, F.lower("salary_currency")).when(F.col("id") % 5 == 1, F.lit(""))
    return v.jobs.select("id", place.otherwise(F.col("country_code")).alias("place"), given.alias("given"), F.col("salary_min").cast("double").alias("amount"), F.concat(F.upper("language"), F.lit("_x")).alias("tag"))


PLACES = f"""{WITH}, pl AS (SELECT id, {PLACE} AS place, CASE id % 5 WHEN 0 THEN lower(salary_currency) WHEN 1 THEN '' END AS given, CAST(salary_min AS DOUBLE) AS amount, upper(language) || '_x' AS tag FROM jobs),
lo AS (SELECT *, lower(trim(place)) AS t FROM pl),
pt AS (SELECT *, list_filter(list_transform(string_split(t, ','), lambda x: {_case(D.COUNTRIES, 'trim(x)')}), lambda x: x IS NOT NULL)[1] AS part, regexp_extract(t, '\\(([a-z]{{2}})\\)', 1) AS c1, regexp_extract(t, '\\[([a-z]{{2}})\\]', 1) AS c2, regexp_extract(t, ',\\s*([a-z]{{2}})$', 1) AS c3 FROM lo),
co AS (SELECT id, given, amount, tag, coalesce({_case(D.COUNTRIES, 't')}, part, {_case(D.COUNTRIES, 'c1')}, {_case(D.COUNTRIES, 'c2')}, {_case(D.COUNTRIES, 'c3')}) AS country FROM pt),
cu AS (SELECT *, coalesce(nullif(upper(given), ''), {_case(D.COUNTRY_CURRENCY, 'country')}, 'USD') AS currency FROM co)"""


def _currencies(v: Views) -> DataFrame:
    rows = _places(v).withColumn("country", E.country("place"))
    return rows.withColumn("currency", E.currency(F.col("given"), F.col("country")))


#: The detector learns from these rows, so that it can be judged by the others.
LEARNT = "id % 5 <> 0"


def _grams(which: str = "") -> str:
    """Grams of all texts, and counts of those that the detector learns from."""
    return f"""WITH {POSTS}, cl AS (SELECT id, language AS label, {CLEAN} AS clean FROM posts),
ch AS (SELECT id, label, lower(clean) AS t, string_split(lower(clean), '') AS l FROM cl),
gr AS (SELECT id, label, unnest(CASE WHEN len(l) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2])) END) AS gram FROM ch),
pr AS (SELECT label, gram, count(*) AS n FROM gr WHERE label IS NOT NULL{which} GROUP BY 1, 2), tt AS (SELECT label, count(*) AS total FROM cl WHERE label IS NOT NULL{which} GROUP BY 1), sh AS (SELECT label, gram, n, total FROM pr JOIN tt USING (label))"""


TEXT = f"WITH {POSTS}, tx AS (SELECT id, lower(title || ' ' || description) AS t, lower(title) AS tt FROM posts)"


def _literal(term: str) -> str:
    return "".join("\\" + c if c in ".()+*?[]{}|^$\\" else c for c in term)


def _whole(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|{WORD}){_literal(term)}($|{WORD})')"


def _held(text: str) -> str:
    return " UNION ALL ".join(f"SELECT id, '{k}' AS skill FROM tx WHERE {_whole(text, k)}" for k in SKILLS)


def _doubled(text: str) -> str:
    """Text with all that is no word character twice, so that neighbours need not share what parts them."""
    return "".join(c if c.isalnum() or c == "_" else c + c for c in text)


# one pattern of all terms, the longest first, as the first alternative that fits is taken; places are counted from what lies before
TERMS = "|".join(_literal(_doubled(t)) for t in sorted((t for t, *_ in LEXICON), key=len, reverse=True))
PATTERN = f"'(?s)(.*?{WORD})({TERMS}){WORD}'"
_WORDS = lambda of: f"length(regexp_replace({of}, '{WORD}', '', 'g'))"
FOUND = rf"""{TEXT}, dd AS (SELECT id, ' ' || regexp_replace(t, '({WORD})', '\1\1', 'g') || ' ' AS d FROM tx),
le AS (SELECT * FROM {_values([(_doubled(t), t, c, k) for t, c, k in LEXICON])} v(doubled, term, canonical, category)),
ma AS (SELECT id, unnest(range(len(a))) AS k, unnest(a) AS whole, unnest(g) AS gap, unnest(m) AS doubled FROM (SELECT id, regexp_extract_all(d, {PATTERN}, 0) AS a, regexp_extract_all(d, {PATTERN}, 1) AS g, regexp_extract_all(d, {PATTERN}, 2) AS m FROM dd)),
wo AS (SELECT *, {_WORDS('whole')} AS ww, {_WORDS('gap')} AS gw FROM ma),
pl AS (SELECT id, doubled, coalesce(sum(ww) OVER b, 0) + gw + (coalesce(sum(length(whole) - ww) OVER b, 0) + length(gap) - gw - 1) // 2 AS start FROM wo WINDOW b AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
me AS (SELECT id, term, canonical, category, start FROM pl JOIN le USING (doubled)),
fo AS (SELECT id, canonical, first(term ORDER BY start) AS term, CAST(min(start) AS INTEGER) AS start, coalesce(min(category), 'unknown') AS category FROM me GROUP BY 1, 2)"""
SK = f"{TEXT}, sk AS ({_held('t')})"


LANG = f"""{_grams(f' AND {LEARNT}')}, hd AS (SELECT DISTINCT gram FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, gram) AS place FROM sh) WHERE place <= 300),
we AS (SELECT hd.gram, tt.label, ln((coalesce(sh.n, 0) + 1)::DOUBLE / (tt.total + 2)) AS weight FROM hd CROSS JOIN tt LEFT JOIN sh ON sh.gram = hd.gram AND sh.label = tt.label),
sc AS (SELECT gr.id, we.label, round(sum(weight), 6) AS score FROM gr JOIN we USING (gram) GROUP BY 1, 2),
po AS (SELECT id, label, 1 / sum(exp(least(o.score - sc.score, 700.0))) AS confidence, row_number() OVER (PARTITION BY id ORDER BY sc.score DESC, label DESC) AS k FROM sc JOIN (SELECT id, label AS other, score FROM sc) o USING (id) GROUP BY id, label, sc.score),
be AS (SELECT id, label, confidence FROM po WHERE k = 1)
SELECT cl.id, CASE WHEN length(clean) < 5 THEN 'en' ELSE coalesce(be.label, 'en') END AS detected, CASE WHEN length(clean) < 5 THEN 0.0 ELSE round(coalesce(be.confidence, 0), 6) END AS confidence FROM cl LEFT JOIN be USING (id)"""


def _chain(v: Views) -> DataFrame:
    name = F.array(*map(F.lit, NAMES))[(F.col("id") % len(NAMES)).cast("int")]
    posts = v.posts.withColumn("location", F.concat(F.lit("Some City, "), name)).withColumn("currency", F.lit(None).cast("string")).withColumn("amount", F.char_length("description").cast("double"))
    s = v.spark
    out = E.enrich_postings(posts, E.language_profile(v.posts.filter(LEARNT)), _terms(v), D.keywords(s), D.negatives(s), D.categories(s), D.aliases(s), _lexicon(v), most_skills=5)
    told = [F.array_join(c, ",").alias(c) for c in ("skills", "matched_terms")]
    return out.select("id", "detected", F.round("language_confidence", 6).alias("language_confidence"), *told, "is_tech", "category", F.round("tech_confidence", 6).alias("tech_confidence"), "country", "currency", F.round("usd", 4).alias("usd"))


def _terms(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(k,) for k in SKILLS], "term string")


def _lexicon(v: Views) -> DataFrame:
    return v.spark.createDataFrame(LEXICON, "term string, canonical string, category string")


ENTRIES = {
    "en_lang_clean": (lambda v: v.posts.select("id", F.md5(E.clean_for_language(F.col("title"), F.col("description"))).alias("digest")), f"WITH {POSTS} SELECT id, md5({CLEAN}) AS digest FROM posts"),
    "en_lang_profile": (lambda v: E.language_profile(v.posts), f"{_grams()} SELECT label, gram, n, total FROM sh"),
    "en_lang_detect": (
        lambda v: E.detect_language(v.posts, E.language_profile(v.posts.filter(LEARNT))).select("id", "detected", F.round("confidence", 6).alias("confidence")),
        LANG,
    ),
    "en_skills": (lambda v: E.extract_skills(_texts(v), _terms(v)), f"{SK} SELECT id, skill FROM sk"),
    "en_skills_title": (lambda v: E.extract_skills(v.posts.select("id", F.col("title").alias("text")), _terms(v)), f"{TEXT} {_held('tt')}"),
    "en_skill_names": (
        lambda v: E.display_names(E.extract_skills(_texts(v), _terms(v)), SKILLS).select("id", F.array_join("skills", ",").alias("skills")),
        f"{SK} SELECT id, string_agg({_case(SKILLS, 'skill')}, ',' ORDER BY {_case(SKILLS, 'skill')}) AS skills FROM sk GROUP BY 1",
    ),
    "en_country": (lambda v: _currencies(v).select("id", "country"), f"{PLACES} SELECT id, country FROM cu"),
    "en_currency": (lambda v: _currencies(v).select("id", "currency"), f"{PLACES} SELECT id, currency FROM cu"),
    "en_convert_usd": (lambda v: _currencies(v).select("id", F.round(E.to_usd(F.col("amount"), F.col("currency")), 4).alias("usd")), f"{PLACES} SELECT id, round(amount * coalesce(CAST({_case(D.USD, 'currency')} AS DOUBLE), 1.0), 4) AS usd FROM cu"),
    "en_convert": (
        lambda v: _currencies(v).select("id", F.round(E.convert(F.col("amount"), F.col("currency"), F.lit("EUR")), 4).alias("euros")),
        f"{PLACES} SELECT id, round(amount * coalesce(CAST({_case(D.USD, 'currency')} AS DOUBLE) / {D.USD['EUR']}, 1.0), 4) AS euros FROM cu",
    ),
    "en_lang_code": (
        lambda v: _places(v).select("id", E.language_info("tag").alias("i")).select("id", "i.*").withColumn("back", E.language_by_name("name")),
        f"""{PLACES}, co2 AS (SELECT id, tag, coalesce(split_part(replace(lower(tag), '_', '-'), '-', 1), 'en') AS code FROM cu), la AS (SELECT * FROM {_values([(k, *v) for k, v in D.LANGUAGES.items()])} v(code, name, native, icon))
SELECT id, co2.code, la.code IS NOT NULL AS supported, coalesce(name, tag, '') AS name, coalesce(native, tag, '') AS native_name, coalesce(icon, '{D.UNKNOWN_ICON}') || ' ' || CASE WHEN la.code IS NOT NULL THEN upper(co2.code) ELSE coalesce(upper(tag), 'UNK') END AS badge, la.code AS back FROM co2 LEFT JOIN la ON la.code = co2.code""",
    ),
    "en_lexicon": (lambda v: E.find_technologies(_texts(v), _lexicon(v)), f"{FOUND} SELECT id, term, canonical, category, start, start + CAST(length(term) AS INTEGER) AS \"end\" FROM fo"),
    "en_chain": (
        _chain,
        f"""SELECT dt.id, detected, round(confidence, 6) AS language_confidence, coalesce(skills, '') AS skills, CASE WHEN is_tech THEN coalesce(matched_terms, '') ELSE '' END AS matched_terms, is_tech, category, round(tech_confidence, 6) AS tech_confidence, country, currency, round(usd, 4) AS usd FROM ({LANG}) dt
LEFT JOIN ({SK} SELECT id, count(*) AS held, string_agg(skill, ',' ORDER BY skill) AS skills FROM sk GROUP BY 1) s USING (id) JOIN ({FINAL} SELECT id, is_tech, category, tech_confidence FROM done) f USING (id)
LEFT JOIN ({FOUND} SELECT id, string_agg(canonical, ',' ORDER BY canonical) AS matched_terms FROM fo GROUP BY 1) m USING (id)
JOIN (SELECT *, length_ * CAST({_case(D.USD, 'currency')} AS DOUBLE) AS usd FROM (SELECT *, {_case(D.COUNTRY_CURRENCY, 'country')} AS currency FROM (SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS length_, {_case(D.COUNTRIES, f"lower([{', '.join(repr(n) for n in NAMES)}][1 + doc_id % {len(NAMES)}])")} AS country FROM documents))) p USING (id) WHERE coalesce(held, 0) <= 5""",
    ),
    "en_lexicon_stats": (lambda v: E.lexicon_stats(E.find_technologies(_texts(v), _lexicon(v))), f"{FOUND} SELECT category, count(*) AS mentions, count(DISTINCT canonical) AS terms, count(DISTINCT id) AS postings FROM fo GROUP BY 1"),
    "src_raw_postings": (lambda v: files.read_raw(v.spark, _landed(v), "xx").groupBy("_source_country").agg(F.count("*").alias("count"), F.sum(F.char_length("raw")).alias("chars")), f"{WITH}, {RECORDS} SELECT 'xx' AS _source_country, count(*) AS count, CAST(sum(length(raw)) AS BIGINT) AS chars FROM records"),
    "src_terms": (_dictionary, "SELECT DISTINCT lower(trim(p_name)) AS term FROM part UNION ALL SELECT 'built in'"),
    "src_labeled": (_labeled, f"WITH {POSTS} SELECT id % 2 = 0 AS is_tech_role, 'c' || (id % 3) AS expected_category, count(*) AS count, CAST(sum(length(description)) AS BIGINT) AS chars FROM posts GROUP BY 1, 2"),
    "snk_label_export": (
        _exported,
        rf"WITH {POSTS}, q AS (SELECT id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, trim(regexp_replace(description, '\s+', ' ', 'g')) AS d, language, source_site FROM posts) SELECT id, title, md5(CASE WHEN length(d) <= 2000 THEN d ELSE coalesce(nullif(regexp_extract(substr(d, 1, 2000), '^(.*) ', 1), ''), substr(d, 1, 2000)) || '...' END) AS digest, language AS country, source_site AS source, language || ', ' || source_site AS skills, id / 4.0 AS classifier_score, '' AS is_tech, '' AS notes FROM q",
    ),
    "st_ingest": (
        _ingested,
        f"""{WITH}, one AS (SELECT *, {HELD} AS held FROM ({RAW})), two AS (SELECT *, {HELD} AS held FROM (SELECT * REPLACE ('again ' || title AS title) FROM ({RAW}) WHERE id % 19 = 0)), li AS (SELECT * FROM two WHERE len(held) <= 2 UNION ALL SELECT * FROM one WHERE len(held) <= 2 AND id NOT IN (SELECT id FROM two WHERE len(held) <= 2))
SELECT source_id, title, {COMPANY} AS company_name, location, {PAID.format('salary_min')} AS salary_min, {PAID.format('salary_max')} AS salary_max, {CURRENCY} AS salary_currency, {KIND} AS employment_type, true AS is_active FROM li""",
    ),
    "st_dedupe": (_once, "SELECT event_id, user_id FROM events"),
    "st_daily_counts": (_daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1"),
}
