"""Cases of the findings of round 3."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from laborlens.operators import classify, enrich, load, terms, transform
from laborlens.plans import registry
from tests.compare import differences


def test_profile_counts_every_labelled_text(spark, sf):
    got = registry.queries()["en_lang_profile"](spark, sf).select("label", "total").distinct()
    there = spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").count().filter("lang is not null")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in there.collect()}


def _plain(text):
    text = text.lower()
    return {text[i : i + 3] for i in range(len(text) - 2)} or {text}


def test_trigrams_by_number_are_those_of_the_text(monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcé\0ßİ中\U0001f600 xyz", k=draw.choice([0, 1, 2, 3, 5, 50, 500]))) for _ in range(300)]
    tally, plain = enrich._Tally(), Counter()
    for k, text in enumerate(texts):
        tally.add(text)
        plain.update(_plain(text) if text else ())
        if k % 70 == 0:
            tally.settle()
    tally.settle()
    assert dict(zip(enrich._spelt(tally.codes), tally.n.tolist(), strict=True)) == plain and tally.texts == len(texts)
    grams = draw.sample(sorted(plain), 200)
    for places in (enrich.PLACES, 1):
        monkeypatch.setattr(enrich, "PLACES", places)
        search = enrich._Places(grams)
        assert all(search(t).tolist() == sorted(k for k, g in enumerate(grams) if g in _plain(t)) for t in texts)


def test_profile_reads_the_texts_once(spark):
    rows = spark.createDataFrame([(1, "a", "abc", "abc")], "id long, language string, title string, description string")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    profile = enrich.language_profile(rows.withColumn("description", seen("description")))
    enrich.language_weights(profile).collect()
    assert reads.value == 1


def test_record_is_parsed_once(spark, sf):
    plan = registry.queries()["tr_datetime"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_normalised_text_is_that_of_the_plain_rule(spark):
    texts = ["", " ", "A  b", "a!b", "a! b", "!a\t", "x\n\ny & z^", "[c++] (node.js)-\"#1\"/2", "a\xa0b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce("t", F.lit(""))), classify.PUNCTUATION, " " * len(classify.PUNCTUATION)), r"\s+", " "))
    assert all(r.a == r.b for r in rows.select(classify.normalize("t").alias("a"), plain.alias("b")).collect())


def test_pairs_are_dealt_by_their_number(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, " A"), (2, "b")], "job_id long, name string")
    known = spark.createDataFrame([(2, "b")], "job_id long, name string")
    got = load.new_links(pairs, known, 9_000_000)
    assert [tuple(r) for r in got.collect()] == [(1, "a")]
    assert "hashpartitioning(job_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 9)" in plan


def test_classes_follow_each_other_in_all_texts(spark):
    import numpy as np

    from laborlens.llm import attention_lm as lm

    unit, _, klass = lm.groups(np.zeros(lm.IDS))
    rows = spark.createDataFrame([(bytearray(b"the of and the"),), (bytearray(b""),), (bytearray(b"of"),)] * 50, "text binary").repartition(3)
    got = lm.across_counts(rows, unit, klass, np.ones(len(klass), bool))
    assert got.sum() == 50 * (5 + 1 + 2)
    windows = lm.windows_of([b"the of and the", b"", b"of " * 40], unit, lm.lexicon())
    assert (windows[:, lm.WINDOW :] >= 0).sum() == 5 + 1 + 41


def _pieces(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_read_by_one_expression(spark):
    given = [
        '{"id":1,"title":"a"}', '{"id":1.50,"title":true,"company":[1],"location":{"display_name":3},"salary":5,"salary_min":"12.5","salary_max":"x","created":"20200102"}', "[1]", "nope", "",
        '{"id":"x","title":"t","salary":{"min":"7","max":1e3,"currency":null},"salary_currency":"EUR","created":"2020-01-02T03","category":{"label":null},"company":{"name":"q"},"location":"{odd"}',
    ]
    rows = transform.transform(spark.createDataFrame([(g, "xx") for g in given], "raw string, _source_country string"), "feed", "2001-08-01")
    shown = rows.select("source_id", "title", "company_name", "location", "salary_min", "salary_max", "salary_currency", F.date_format("posted_date", "yyyy-MM-dd HH"), "category").collect()
    assert sorted(map(tuple, shown)) == [
        ("1", "a", "Unknown", "", None, None, None, None, ""), ("1.5", "true", "[1]", "3", 12.5, None, None, "2020-01-02 00", ""), ("x", "t", "Unknown", "", 7.0, 1000.0, "EUR", "2020-01-02 03", ""),
    ]
    # one for the record, and two for each of company, location and category
    assert _pieces(rows).count("try_variant_get") <= 20


def test_languages_are_judged_in_batches(spark):
    profile = spark.createDataFrame([("en", "the", 2, 2), ("de", "der", 2, 2)], "label string, gram string, n long, total long")
    rows = spark.createDataFrame([(1, "the end", ""), (2, "der Hut", ""), (3, "the", ""), (4, "xyzxyz", ""), (5, None, None)], "id long, title string, description string")
    found = enrich.detect_language(rows, profile)
    assert "Join" not in _pieces(found)
    assert {r.id: (r.detected, round(r.confidence, 2)) for r in found.collect()} == {1: ("en", 0.75), 2: ("de", 0.75), 3: ("en", 0.0), 4: ("en", 0.0), 5: ("en", 0.0)}


def test_skills_are_told_beside_their_text(spark):
    rows = spark.createDataFrame([(1, "C++ and the rest, the c++"), (1, "x"), (2, None)], "id long, text string")
    known = spark.createDataFrame([("the",), ("c++",), ("res",), ("the",)], "term string")
    for block in (terms.BLOCK, 1):
        told = rows.select("id", terms.held(F.col("text"), known, block).alias("skills")).filter(F.size("skills") < 3)
        assert _pieces(told).count("find(") <= len(known.distinct().collect()) and "Aggregate" not in _pieces(told)
        assert sorted((r.id, r.skills) for r in told.collect()) == [(1, []), (1, ["c++", "the"]), (2, [])]


def test_evidence_collects_no_lists_of_rows(spark):
    hits = spark.createDataFrame([(1, "title", "a", 1), (1, "description", "a", 5), (2, "description", "a", 2), (2, "skills", "b", 1)], "id long, source string, keyword string, n long")
    factors = spark.createDataFrame([(1, "title", 0.5), (1, "description", 0.25), (2, "description", 1.0), (2, "skills", 1.5)], "id long, source string, factor double")
    words = spark.createDataFrame([("x", "a", 4.0), ("x", "a", 8.0), ("y", "b", 20.0)], "category string, keyword string, weight double")
    got = classify.evidence(hits, factors, words)
    # the keyword that is named twice applies with both weights; a source that a posting lacks applies with none
    assert {(r.id, r.category, r.keyword): r.contribution for r in got.collect()} == {(1, "x", "a"): 4.0 + 2.0 * 0.5 + 2.0 * 0.333, (2, "x", "a"): 8.0 + 8.0 * 0.5 + 4.0 * 0.333, (2, "y", "b"): 15.0}
    assert "collect_list(w#" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_matched_terms_make_their_evidence_once(spark, sf):
    read = {f.rsplit("/", 2)[1].rsplit("-", 5)[0] for f in registry.queries()["cl_matched_terms"](spark, sf).inputFiles()}
    assert "evidence" in read and "hits" not in read


def test_words_are_encoded_together_as_one_by_one():
    from laborlens.llm import attention_lm as lm

    encode, calls = lm.lexicon().encode, []
    told = lambda text: calls.append(text) or encode(text)
    plain = [b"the", b"'s", b"don't", b"caf\xc3\xa9", b"\xff\xfe", b"12ab!?", b"\xe2\x80\x8b", b"<|endoftext|>", b"x" * 300]
    for words, many in ((plain, 1), ([*plain, b"a\xc2\xa0b"], 10), ([*plain, b"\x1c"], 10), ([b"\xe2\x80\x83", b"a"], 2), ([], 1)):
        calls.clear()
        ids, size = lm.ids_of_words(words, told)
        want = [encode(" " + w.decode("utf-8", "replace")) for w in words]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, []) and len(calls) == many


def test_ids_of_texts_are_written_once_and_equal_those_of_the_texts(spark):
    import numpy as np

    from laborlens.llm import attention_lm as lm

    texts = [b"", b"of the", b"Zyx " * 50, b"a\xc2\xa0b \xff"]
    rows = spark.createDataFrame([("x", bytearray(t)) for t in texts] + [(None, bytearray(b"of"))], "id string, text binary").coalesce(1)
    got = lm.encoded(rows)
    assert got.columns == ["id", "ids"] and [r.id for r in got.collect()] == ["x"] * 4 + [None]
    unit, _, klass = lm.groups(np.arange(lm.IDS, dtype=float))
    ids, lengths = lm._read_ids(got.select("ids").toArrow()["ids"].combine_chunks())
    assert lengths[:2].tolist() == [1, 3] and (lm.windows_of_ids(ids, lengths, unit) == lm.windows_of([*texts, b"of"], unit, lm.lexicon())).all()
    starts = np.ones(len(klass), bool)
    assert (lm.across_counts(got.select("ids"), unit, klass, starts) == lm.across_counts(rows.select("text"), unit, klass, starts)).all()


def test_steps_of_a_pass_grow_in_size_before_they_grow_in_number(monkeypatch):
    import numpy as np

    from laborlens.llm import attention_lm as lm

    unit, share, klass = lm.groups(np.zeros(lm.IDS))
    u = len(klass)
    classes = lm.Classes(np.zeros(lm.IDS), np.ones(u), np.ones(lm.CLASSES), np.ones((lm.CLASSES, u)), np.ones((lm.CLASSES, u)), (unit, share, klass))
    sizes, own = [], lm.loss_and_gradient
    monkeypatch.setattr(lm, "loss_and_gradient", lambda w, inputs, *rest: sizes.append(len(inputs)) or own(w, inputs, *rest))
    windows = np.random.default_rng(1).integers(0, 60, (20_000, lm.WINDOW + lm.HALF)).astype(np.int16)
    given = lm.start_weights()
    weights, loss = lm.train_pass(given, windows, classes, seed=1)
    assert sum(sizes) == len(windows) and len(sizes) <= lm.STEPS + 2 and np.isfinite(loss)
    # the weights that were given stay as they are: other tasks of the worker start from them
    assert all((given[k] == v).all() for k, v in lm.start_weights().items()) and any((weights[k] != given[k]).any() for k in given)


#: Texts that have no gram, an empty one, blanks that are none to the SQL or the reverse, capitals that Python makes small in its own way, and a long suffix.
ODD = {
    "null": [None, None], "empty": ["", "  ", "\n", " \t\r\n\f "], "tab": ["ab\x0bcd", "\x0b", "Koch (m/\x0bw)"], "ends": ["\xa0abc\u2003", "\u3000 \xa0", "a\xa0 b"], "capitals": ["İİ İstanbul", "İ", "ΟΔΟΣ ΣΑΣ", "aΣ"],
    "long": ["Koch (" + "m/" * 20_000 + "w) ende"],
}


@pytest.mark.parametrize("kind", ODD)
def test_languages_of_odd_texts_are_those_of_the_sql(kind, spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    rows = [(1, "the plain text\nand more", "en", "s"), (2, "der Text\nund mehr", "de", "s"), *((k, text, ("en", "de", None)[k % 3], "s") for k, text in enumerate(ODD[kind] * 3, 3))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for name in ("en_lang_clean", "en_lang_profile", "en_lang_detect"):
        assert not differences(registry.queries()[name](spark, str(tmp_path)), db, registry.oracle_sql()[name])


def test_counts_of_grams_told_in_parts_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(enrich, "ROWS", 1)
    monkeypatch.setattr(enrich, "COUNTED", 0)
    monkeypatch.setattr(enrich, "GATHERED", 0)
    given = [(1, "a", "", ""), (2, "a", "ab", None), (3, "a", None, None), (4, "a", "", None), (5, None, "", ""), (6, "b", None, None)]
    rows = spark.createDataFrame(given, "id long, language string, title string, description string").coalesce(1)
    assert sorted(map(tuple, enrich.language_profile(rows).collect())) == [("a", "", 2, 4), ("a", "ab", 1, 4)]
