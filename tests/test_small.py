"""Hand-computed cases."""

import re

import pytest
from pyspark.sql import functions as F

from laborlens.operators import analytics, balance, classify, dims, enrich, evaluate, filters, load, quality, sampling, terms, transform
from laborlens.sources import files


def test_largest_remainders(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 30), ("c", 19), ("d", 1)], "g string, count long")
    seats = {r.g: r.seats for r in sampling.allocate(counts, "g", 10).collect()}
    assert seats == {"a": 5, "b": 3, "c": 2, "d": 0}
    assert {r.g: r.seats for r in sampling.allocate(counts, "g", 10, 1).collect()}["d"] == 1


def test_evidence_diminishes_and_is_capped(spark):
    hits = spark.createDataFrame([(1, "title", "x", 2), (1, "description", "x", 5), (2, "title", "y", 1)], "id long, source string, keyword string, n long")
    factors = spark.createDataFrame([(1, "title", 0.5), (1, "description", 0.25), (2, "title", 1.0)], "id long, source string, factor double")
    words = spark.createDataFrame([("k", "x", 8.0), ("k", "y", 40.0)], "category string, keyword string, weight double")
    got = {r.id: r.contribution for r in classify.evidence(hits, factors, words).collect()}
    assert abs(got[1] - (4 + 4 * 0.5 + 2 * 0.333)) < 1e-9 and got[2] == 15.0


def test_parents_dont_compete(spark):
    scores = spark.createDataFrame([(1, "french", 20.0), (1, "roman", 19.0), (1, "german", 10.0), (2, "french", 20.0), (2, "german", 19.0)], "id long, category string, score double")
    got = {r.id: (r.category, r.margin, r.outcome) for r in classify.decisions(scores, dims.categories(spark)).collect()}
    assert got == {1: ("french", 10.0, "SUCCESS"), 2: ("french", 1.0, "MARGIN_TOO_LOW")}


def test_curves(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, is_tech boolean")
    assert evaluate.roc_auc(rows).first()[0] == (2 + 1.5) / 4
    assert abs(evaluate.pr_auc(rows).first()[0] - (0.5 * 1 + 0.5 * (1 + 2 / 3) / 2)) < 1e-9


def test_loading_twice_changes_nothing(spark):
    row = (1, "s", "a", 1, "t", "c", "l", None, None, "USD", None, None, "en", True, "k", "US", None, False, True)
    names = "id long, source_site string, source_id string, arrival int, title string, company_name string, location string, salary_min decimal(12,2), salary_max decimal(12,2), salary_currency string, employment_type string, posted_date timestamp, language string, is_tech_role boolean, technology_category string, country_code string, scraped_date timestamp, is_active boolean, is_deleted boolean"
    batch = spark.createDataFrame([row, (2, "s", "b", *row[3:]), (3, "s", "b", 2, "later", *row[5:])], names)
    empty = batch.limit(0).drop("arrival")
    once = load.upsert(empty, batch, "2001-08-01")
    twice = load.upsert(once, batch, "2001-08-01")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.filter("title = 'later' and is_active").count() == 1
    assert tuple(load.load_counts(empty, batch).first()) == (2, 1) and tuple(load.load_counts(once, batch).first()) == (0, 3)


def test_dictionaries(spark):
    assert classify.dim_violations(dims.keywords(spark), dims.categories(spark)).count() == 0
    found = {(r.policy, r.category): (r.tech_minimum, r.minimum_margin) for r in classify.policy_thresholds(dims.policies(spark), dims.overrides(spark), dims.categories(spark)).collect()}
    assert len(found) == 15 and found["default", "roman"] == (6.0, 3.0) and found["conservative", "english"] == (12.0, 5.0)
    pairs = {(r.a, r.b) for r in classify.competitors(dims.categories(spark)).collect()}
    assert ("french", "spanish") in pairs and ("french", "roman") not in pairs and ("roman", "french") not in pairs


def test_labelled_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "x", "description": "y", "is_tech_role": true}]')
    (tmp_path / "b.json").write_text('{"jobs": [{"title": "p"}, {"title": "q"}]}')
    (tmp_path / "c.csv").write_text('title,description,is_tech_role,expected_category\n"a, b",text,true,k\n')
    assert {r.title for r in files.read_labeled(spark, f"{tmp_path}/*.json").collect()} == {"x", "p", "q"}
    assert files.read_labeled(spark, f"{tmp_path}/c.csv").first().title == "a, b"


def test_salaries_are_swapped_or_rejected(spark):
    rows = spark.createDataFrame([(1, 5.0, 3.0), (2, -1.0, 3.0), (3, None, 3.0)], "id long, salary_min double, salary_max double")
    got = {r.id: (r.salary_min, r.salary_max, r.warning, r.rejected) for r in quality.salaries(rows).withColumn("rejected", F.coalesce("rejected", F.lit(False))).collect()}
    assert got == {1: (3.0, 5.0, "salary_swapped", False), 2: (-1.0, 3.0, None, True), 3: (None, 3.0, None, False)}


def test_terms_of_symbols_and_several_words(spark):
    texts = spark.createDataFrame([(1, "Senior C++ and C# (node.js) engineer, machine learning; xnode.jsx c++17"), (2, "python-based .NET, asp.net"), (3, None), (4, "machine  learning")], "id long, text string")
    words = spark.createDataFrame([(t,) for t in ("c++", "c#", "node.js", "machine learning", "python", ".net", "(senior dev")], "term string")
    found = enrich.extract_skills(texts, words).collect()
    assert {(r.id, r.skill) for r in found} == {(1, "c++"), (1, "c#"), (1, "node.js"), (1, "machine learning"), (2, "python"), (2, ".net")}
    hits = {(r.id, r.keyword): r.n for r in classify.keyword_hits(texts.select("id", F.col("text").alias("title")).fillna(""), words.select(F.col("term").alias("keyword"))).collect()}
    assert hits == {(1, "c++"): 2, (1, "c#"): 1, (1, "node.js"): 2, (1, "machine learning"): 1, (2, "python"): 1, (2, ".net"): 2}


def test_minimum_seats_come_first(spark):
    counts = spark.createDataFrame([("a", 97), ("b", 1), ("c", 1), ("d", 1)], "g string, count long")
    assert {r.g: r.seats for r in sampling.allocate(counts, "g", 4, 1).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}
    assert {r.g: r.seats for r in sampling.allocate(counts, "g", 3, 1).collect()} == {"a": 3, "b": 0, "c": 0, "d": 0}


def test_postings_without_country_are_not_the_total(spark):
    jobs = spark.createDataFrame([("DE", True), (None, True), (None, False)], "country_code string, is_tech_role boolean")
    got = {(r.country, r.is_total): r.total for r in balance.composition(jobs).collect()}
    assert got == {("DE", False): 1, (None, False): 2, (None, True): 3}


def test_countries_and_currencies(spark):
    rows = spark.createDataFrame([("China",), ("Some City, Germany",), ("Town (us)",), ("Town [uk]",), ("Nowhere, na",), ("Place (zz)",), (None,)], "place string")
    assert [r[0] for r in rows.select(enrich.country("place")).collect()] == ["CN", "DE", "US", "GB", None, None, None]
    usd = spark.range(1).select(enrich.convert(F.lit(10.0), F.lit("USD"), F.lit("EUR"), {"USD": 1.0, "EUR": 2.0}), enrich.convert(F.lit(10.0), F.lit("?"), F.lit("EUR"))).first()
    assert tuple(usd) == (5.0, 10.0)


def test_iso_times(spark):
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250+02:00", "2024-01-02", "20240102", "2024-01-02 03:04", "2024-01-02T03:04-0530", "2024-01-02T03", "soon", "2024", "2024-02-30", None]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "t string").select(F.date_format(transform.iso(F.col("t")), "dd HH:mm:ss.SSS")).collect()]
    assert got == ["02 03:04:05.000", "02 01:04:05.250", "02 00:00:00.000", "02 00:00:00.000", "02 03:04:00.000", "02 08:34:00.000", "02 03:00:00.000", None, None, None, None]


def test_first_category_of_the_older_rule(spark):
    posts = spark.createDataFrame([(1, "C++ dev", ["git"]), (2, "Nurse", ["data science"]), (3, "Cook", []), (4, None, None)], "id long, title string, skills array<string>")
    words = spark.createDataFrame([("data", "data science", 2), ("code", "c++", 1)], "category string, keyword string, rank int")
    assert {r.id: r.category for r in classify.first_category(posts, words).collect()} == {1: "code", 2: "data", 3: "other", 4: "other"}


def plain_mentions(text, words, inside=()):
    """Of mentions of a term that overlap the first; by the rules of regular expressions."""
    out = {}
    for w in words:
        pattern = re.escape(w) if w in inside else rf"(?<!\w){re.escape(w)}(?!\w)"
        found = [m.span() for m in re.finditer(pattern, text.lower())]
        if found:
            out[w] = (len(found), *found[0])
    return out


@pytest.mark.parametrize("block", [terms.BLOCK, 2])
def test_mentions_equal_regular_expressions(spark, block):
    words = ["a", "a a", "aa", "b-a", "c++", "é", "a_b", "naïve b", "x" * 40]
    texts = ["a a a a", "aa aaa, b-a; ab-a b-ab", "C++ c++x xc++ c++", "éa é a_b a_bc", None, "", "naïve  b naïve b", "x" * 40 + " " + "x" * 41]
    rows = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(3, texts[3], 5)], "id long, text string, term long").drop("term")
    known = spark.createDataFrame([(w, w in ("c++", "b-a")) for w in [*words, "", " a"]], "term string, inside boolean")
    got = terms.mentions(rows, known, block=block).collect()
    for k, t in enumerate(texts):
        of = sorted((r.term, r.n, r.start, r.end) for r in got if r.id == k)
        assert of == sorted((w, *v) for w, v in plain_mentions(t or "", words, ("c++", "b-a")).items() for _ in range(2 if k == 3 else 1))
    assert terms.mentions(rows, known.limit(0)).count() == 0 and terms.mentions(rows.limit(0), known).count() == 0


@pytest.mark.parametrize("block", [terms.BLOCK, 1])
def test_the_longest_of_the_leftmost_terms_is_taken(spark, block):
    known = [("license", "license", "law"), ("apache license", "apache", "law"), ("apache license 2", "apache 2", None), ("license 2.0", "two", "law"), ("asf", "apache", "law")]
    texts = [(1, "Apache License only"), (2, "apache license 2.0"), (3, "the license, apache-license; asf"), (4, "apache licenses"), (5, None)]
    lexicon = spark.createDataFrame(known, "term string, canonical string, category string")
    found = terms.mentions(spark.createDataFrame(texts, "id long, text string"), lexicon.select("term"), longest=True, block=block)
    assert sorted((r.id, r.term, r.n, r.start, r.end) for r in found.collect()) == [
        (1, "apache license", 1, 0, 14), (2, "apache license 2", 1, 0, 16), (3, "asf", 1, 29, 32), (3, "license", 2, 4, 11),
    ]
    tech = enrich.find_technologies(spark.createDataFrame(texts, "id long, text string"), lexicon).collect()
    assert sorted((r.id, r.canonical, r.category, r.start) for r in tech) == [(1, "apache", "law", 0), (2, "apache 2", "unknown", 0), (3, "apache", "law", 29), (3, "license", "law", 4)]


def test_skills_are_evidence(spark):
    posts = spark.createDataFrame([(1, "Nurse", "wards", ["K8s", " Python", "python", "pythonic"]), (2, "Python dev", "", None)], "id long, title string, description string, skills array<string>")
    words = spark.createDataFrame([("ops", "kubernetes", 4.0), ("code", "python", 10.0)], "category string, keyword string, weight double")
    other = spark.createDataFrame([("k8s", "Kubernetes")], "alias string, canonical string")
    texts = classify.normalized(posts)
    hits = classify.keyword_hits(texts, words, other)
    assert sorted(map(tuple, hits.collect())) == [(1, "skills", "kubernetes", 1), (1, "skills", "python", 2), (2, "title", "python", 1)]
    got = {(r.id, r.category): round(r.contribution, 9) for r in classify.evidence(hits, classify.field_weights(texts), words).collect()}
    # all three fields: weights as they are, which don't add up to 1; one field: all its own
    assert got == {(1, "ops"): 1.2, (1, "code"): 4.5, (2, "code"): 10.0}


def test_explanations_are_bounded(spark):
    n = classify.PHRASES + 4
    words = spark.createDataFrame([("k", f"big word{i:02}", float(i + 1)) for i in range(n)] + [("k", "solo", 40.0)], "category string, keyword string, weight double")
    hits = spark.createDataFrame([(1, "title", f"big word{i:02}", 1) for i in range(n)] + [(1, "skills", "solo", 1), (1, "title", "solo", 3)], "id long, source string, keyword string, n long")
    texts = spark.createDataFrame([(1, "bad unbadly", "")], "id long, title string, description string")
    minus = spark.createDataFrame([("k", "bad", 2.0), ("k", "solo", 1.0), ("other", "bad", 1.0)], "category string, keyword string, penalty double")
    decided = spark.createDataFrame([(1, "k"), (2, "k")], "id long, category string")
    got = {r.id: r for r in classify.explanations(hits, texts, words, minus, decided, decided.filter("id = 2")).collect()}
    assert (got[1].keywords[0].keyword, got[1].keywords[0].score) == ("solo", 15.0) and len(got[1].keywords) == n + 1
    assert got[1].phrases == [f"big word{i:02}" for i in reversed(range(n))][: classify.PHRASES]
    assert [tuple(x) for x in got[1].negatives] == [("bad", 2.0)] and not got[1].title_pattern_matched
    assert (got[2].keywords, got[2].phrases, got[2].negatives, got[2].title_pattern_matched) == ([], [], [], True)


def test_languages_of_rows_not_learnt_from(spark, sf):
    from laborlens.plans.views import Views

    posts = Views(spark, sf).posts
    told = enrich.detect_language(posts, enrich.language_profile(posts.filter("id % 5 <> 0")))
    held = told.join(posts.filter("id % 5 = 0").select("id", "language"), "id").agg(F.avg((F.col("detected") == F.col("language")).cast("int")).alias("right"), F.min("confidence").alias("least"), F.max("confidence").alias("most")).first()
    assert held.right >= 0.9 and 0 <= held.least <= held.most <= 1


def test_languages_that_are_equally_likely(spark):
    rows = spark.createDataFrame([(1, "a", "abcabc", "x"), (2, "b", "abcabc", "x"), (3, "b", "zzzzz", "x")], "id long, language string, title string, description string")
    told = {r.id: (r.detected, round(r.confidence, 6)) for r in enrich.detect_language(spark.createDataFrame([(1, "qqqqqq", ""), (2, None, None), (3, "abc", "abc")], "id long, title string, description string"), enrich.language_profile(rows.filter("id < 3"))).collect()}
    assert told == {1: ("en", 0.0), 2: ("en", 0.0), 3: ("b", 0.5)}


def test_language_tags(spark):
    got = spark.createDataFrame([("EN",), ("de_AT",), ("xx-Y",), ("",), (None,)], "tag string").select(enrich.language_info("tag").alias("i")).select("i.*").collect()
    assert [(r.code, r.supported, r.name, r.native_name) for r in got] == [("en", True, "English", "English"), ("de", True, "German", "Deutsch"), ("xx", False, "xx-Y", "xx-Y"), ("en", True, "English", "English"), ("en", True, "English", "English")]
    assert got[2].badge == f"{dims.UNKNOWN_ICON} XX-Y" and got[1].badge.endswith(" DE")
    assert [r[0] for r in spark.createDataFrame([(" german ",), ("none",)], "n string").select(enrich.language_by_name("n")).collect()] == ["de", None]


def test_dictionaries_of_skills(spark, tmp_path):
    (tmp_path / "a.json").write_text('["Spark ", "sql", ""]')
    (tmp_path / "b.json").write_text('{"skills": ["SQL", "c++"]}')
    of = lambda path: {r.term for r in files.read_terms(spark, path, ["Fallback"]).collect()}
    assert of(f"{tmp_path}/*.json") == {"spark", "sql", "c++"}
    (tmp_path / "c.txt").write_text("{not json")
    assert of(f"{tmp_path}/c.txt") == of(f"{tmp_path}/none.json") == of(None) == {"fallback"}


def test_parameters_out_of_bounds_are_refused(spark):
    jobs = spark.createDataFrame([], "id long, salary_min double, salary_max double, is_active boolean, is_deleted boolean, posted_date timestamp, company_name string")
    for call in (lambda: analytics.top_by(jobs, "company_name", "c", 0), lambda: analytics.top_by(jobs, "company_name", "c", 101), lambda: analytics.posting_trend(jobs, "2001-01-01", 366), lambda: filters.page(jobs, 0, 5), lambda: filters.search(jobs, min_salary=2, max_salary=1)):
        with pytest.raises(ValueError):
            call()


def test_postings_with_too_many_skills_are_left_out(spark):
    posts = spark.createDataFrame([(1, "red", "green blue", "Some City, Germany", None, 5.0), (2, "red", "", None, "eur", None)], "id long, title string, description string, location string, currency string, amount double")
    words = spark.createDataFrame([("red",), ("green",), ("blue",)], "term string")
    profile = enrich.language_profile(posts.withColumn("language", F.lit("en")))
    args = (posts, profile, words, dims.keywords(spark), dims.negatives(spark), dims.categories(spark))
    both, few = enrich.enrich_postings(*args).collect(), enrich.enrich_postings(*args, most_skills=2).collect()
    assert {r.id: r.skills for r in both} == {1: ["blue", "green", "red"], 2: ["red"]} and [r.id for r in few] == [2]
    assert [(r.is_tech, r.category, r.tech_confidence, r.matched_terms) for r in few] == [(False, None, None, [])]


def test_reports_are_json(spark, tmp_path):
    rows = spark.createDataFrame([(float(s), 5.0, s > 9, s > 7, "A" if s % 3 else "B", 0.1) for s in range(20)], "score double, margin double, is_tech boolean, predicted boolean, reason string, ambiguity double")
    evaluate.write_report(evaluate.report_document(rows), f"file://{tmp_path}/r")
    got = spark.read.json(f"file://{tmp_path}/r").first()
    assert (got.dataset_size, got.class_distribution.tech, got.class_distribution.non_tech, got.optimization.total_combinations) == (20, 10, 10, 153)
    assert got.optimization.best_policy.policy.tech_minimum == 10.0 and got.optimization.best_policy.metrics.f1 == 1.0 and got.recommendations.recommendation == "adopt"
    assert (got.recommendations.top_reason.reason, got.recommendations.top_reason["count"]) == ("A", 13)
