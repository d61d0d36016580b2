"""Cases that every operator meets, exact round trips and brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import attention_lm, decontam, fingerprint, near_dup, packing, secrets, substring_dup, toxicity, warc
from laborlens.llm.common import components, growing, shingles, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component long, id long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, one long text, and columns with names that operators use."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "plain text of a few words here"), (None, None), (4, "one"), (5, "the same text again and again"), (6, "the same text again and again"), (6, "the same text again and again"), (7, long), (8, long + " tail")]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


def words(text):
    return (text or "").encode().lower().split()


# --- 1 ---


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u\r\nx", "a" * 2500), (2, "u", "a" * 2500), (3, None, "é" * 999), (3, None, "é" * 999), (None, "q", None), (4, "k", "WARC/1.1\r\nWARC-Archive-ID: x\r\n\r\n" + "b" * 3000), (5, "k", ""), (6, "k", "b"), (7, "k", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/a"
    archive = warc.write_archives(warc.roles(pages), path, chunk=1000)
    chunks = warc.read_chunks(spark, path, archive)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(chunks).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = i == 1
        want.append((i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want)


def test_warc_of_payloads_larger_than_a_chunk(spark, tmp_path):
    large = "x€" * warc.CHUNK
    pages = spark.createDataFrame([(1, "u", large), (2, "u", large), (3, "u", "")], "page_id long, url string, html string").withColumn("salt", F.lit(1)).withColumn("kept", F.lit(9))
    path = f"file://{tmp_path}/c"
    archive = warc.write_archives(warc.roles(pages), path)
    chunks = warc.read_chunks(spark, path, archive)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= warc.CHUNK
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.records(chunks).collect()}
    digest = hashlib.sha1(large.encode()).hexdigest()
    assert got == {(1, 4 * warc.CHUNK, digest, 2), (2, 4 * warc.CHUNK, digest, None), (3, 0, hashlib.sha1(b"").hexdigest(), None)}


def test_warc_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/b"
    archive = warc.write_archives(warc.roles(pages), path)
    assert warc.records(warc.read_chunks(spark, path, archive)).count() == 0


# --- 2 ---


def test_reparameterised_items_are_found_and_inconsistent_ones_not(spark):
    item = "Yesterday our teacher said: Tom bought 12 apples and gave 5 kg of the apples to Mary , so how many apples does Tom have left ?"
    other = "Yesterday our teacher said: Anna bought 30 apples and gave 7 lbs of the apples to Peter , so how many apples does Anna have left ?"
    mixed = other.replace("Anna have", "Peter have")
    docs = spark.createDataFrame([(1, f"Some words before it. {item} And after."), (2, other), (3, mixed), (4, None), (None, item), (5, "")], "doc_id long, text string").withColumn("item", F.lit(0))
    bench = spark.createDataFrame([(9, item), (8, None), (7, "too short"), (9, item)], "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontam.contaminated(docs, bench).collect()}
    assert got == {1: True, 2: False}
    assert sorted(r.doc_id or 0 for r in decontam.drop_contaminated(docs, bench).collect()) == [0, 3, 4, 5]
    assert decontam.contaminated(docs.limit(0), bench).count() == decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_items_may_mix_windows_with_and_without_placeholders(spark):
    item = "the old farmer walks slowly along the river with a red basket and then sells 12 apples to every child that waits near the wooden bridge before the rain begins"
    docs = spark.createDataFrame([(1, f"Some words before it. {item} and after."), (2, item.replace("12", "30"))], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.coverage, r.slots, r.verbatim) for r in got} == {1: (1.0, 1, True), 2: (1.0, 1, False)}


def test_fillings_may_become_the_same_and_verbatim_text_always_counts(spark):
    sum_ = "a child puts 12 apples and 5 pears in the basket then takes out the ripe ones before counting again what is left over there"
    dates = "On 3 May 1921 Anna Berg met Karl Lund in Oslo , 7 June 1922 Anna Berg left Karl Lund in Bergen"
    named = "yesterday the teacher asked how many apples Tom would have if Mary gave 12 apples back to him before lunch"
    often = "when Tom came home the dog of Tom was asleep and then Tom saw that a letter for Tom lay there while Tom slept until morning came"
    rows = {
        1: sum_.replace("12", "7").replace("5", "7"), 2: dates, 3: dates.lower(), 4: dates.upper(), 5: named.upper(),
        6: named.lower().replace("12", "30"), 7: often.replace("Tom", "Ben").replace("while Ben", "while Sam"), 8: named.replace("Tom", "Sam").replace("Mary", "Sam"),
    }
    items = spark.createDataFrame([(11, sum_), (12, dates), (13, named), (14, often)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontam.contaminated(spark.createDataFrame([*rows.items()], "doc_id long, text string"), items).collect()}
    assert got == {(1, 11): False, (2, 12): True, (3, 12): True, (4, 12): True, (5, 13): True, (6, 13): False, (7, 14): False}


def test_decontamination_cases(spark):
    item = "the old farmer walks slowly along the river with a red basket and then sells 12 apples to every child that waits near the wooden bridge before the rain begins"
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long), (3, None), (4, ""), (5, item), (5, item)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(7) for c in ("hash", "id", "size", "pos", "item", "fill")})
    items = spark.createDataFrame([(9, item), (10, item), (11, None)], "item_id long, text string").withColumns({c: F.lit("x") for c in ("hash", "doc_id", "size", "pos")})
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(d, i) for d in (1, 5) for i in (9, 10)}
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_repeats_in_very_long_texts(spark):
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    docs = [(1, text(40_000) + passage + text(40_000)), (2, text(30_000) + passage), (3, text(50_000))]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "component", "side", "words")})
    got = {(r.doc_id, r.start, r.n_words, r.removed) for r in substring_dup.repeated_passages(rows).collect()}
    assert got == {(1, 40_000, 60, False), (2, 30_000, 60, True)}


def test_decontamination_against_brute_force(spark, sf, texts):
    items = {r.item_id: r.text.lower().split() for r in table(spark, sf, "benchmark").collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if " ".join(w[1:-1]) in " ".join(t.lower().split())}
    got = {(r.doc_id, r.item_id) for r in decontam.op2_template_decontamination(spark, sf).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


# --- 4 ---


def test_nearest_examples_are_exact(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents").filter("doc_id % 2 = 0")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    n, v = len(model.ids), len(model.weight)
    dense = np.zeros((n, v))
    term = np.repeat(np.arange(v), model.cuts[:, -1] - model.cuts[:, 0])
    dense[model.example, term] = model.posted
    assert n > toxicity.BLOCK and v > 1000 and np.allclose((dense * dense).sum(axis=1), 1)
    for k in range(0, n, 7):
        terms = np.flatnonzero(dense[k])
        cosines = np.round(dense @ dense[k], 12)
        want = np.lexsort((model.ids, -cosines))[: toxicity.NEIGHBOURS]
        got = model.nearest(terms, dense[k][terms])
        assert got[0].tolist() == want[cosines[want] > 0].tolist() and np.allclose(got[1], cosines[want][cosines[want] > 0])


def test_most_texts_have_evidence(spark, sf):
    got = toxicity.op4_toxicity(spark, sf.replace("sf0.001", "sf0.01")).selectExpr("avg(if(size(evidence) > 0, 1, 0)) as share", "count(distinct score) as scores").first()
    assert got.share > 0.95 and got.scores > 20


def test_toxicity_learns_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = toxicity.op4_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    clean = [r for r in got if r.toxic == 0]
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity_cases(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, None), (7, 3), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, toxicity.fit(odd, labels)).count() == odd.count()
    model = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, model).collect()} == {0.5}
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), toxicity.fit(odd.limit(0), labels)).count() == 0


def test_the_bound_on_examples_holds_for_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 40)
    labels = spark.createDataFrame([(1, 1), *((k, 0) for k in range(2, 20))], "doc_id long, toxic int")
    rows = [(1, f"bad word{k} text") for k in range(2000)] + [(k, f"good thing{k} here") for k in range(2, 20)]
    assert len(toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels).ids) == 40
    model = toxicity.fit(spark.createDataFrame([(1, "the same")] * 2000 + rows[2000:], "doc_id long, text string"), labels)
    assert sorted(model.ids) == list(range(1, 20))


# --- 5 ---


def test_repeated_passages(spark):
    rnd = random.Random(3)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    docs = {}
    for k in range(20):
        passage = text(60)
        for j in (0, 1):
            docs[2 * k + j] = " ".join(text(80) + passage + text(70))
    for k in range(20):
        passage = text(120)
        docs[200 + 2 * k], docs[201 + 2 * k] = " ".join(passage + text(50)), " ".join(text(50) + passage[:60] + ["other"] + passage[61:])
        docs[100 + k] = " ".join(text(200))
    inside = " ".join(text(70))
    docs[150] = f"{inside} x {inside}"
    rows = spark.createDataFrame([*docs.items(), (300, None), (301, ""), (None, docs[0]), (100, docs[100])], "doc_id long, text string").withColumn("first", F.lit(1)).repartition(3)
    got = substring_dup.repeated_passages(rows).collect()
    found = {r.doc_id for r in got}
    assert len(found & set(range(40))) >= 38 and found >= set(range(200, 240)) and not found & {*range(100, 151), 300, 301}
    assert all(r.removed == (r.first_id != r.doc_id) for r in got)
    assert substring_dup.repeated_passages(rows.limit(0)).count() == 0


def test_a_keepers_passage_is_in_no_removed_run(spark):
    rnd = random.Random(6)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    a, both, b = text(90), text(40), text(90)
    docs = {3: text(40) + a + both + text(40), 5: text(40) + a + both + b + text(40), 9: text(40) + both + b + text(40)}
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    left = {k: [True] * len(w) for k, w in docs.items()}
    for r in substring_dup.repeated_passages(rows).filter("removed").collect():
        left[r.doc_id][r.start : r.start + r.n_words] = [False] * r.n_words
    assert all(left[3]) and all(left[5][170:]) and sum(left[5][40:130]) < 40 and sum(left[9][80:170]) < 40


def test_short_and_periodic_passages_are_whole(spark):
    rnd = random.Random(7)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    docs, place = {}, {}
    for k in range(400):
        passage = text(51) if k < 380 else text(1 + k % 4) * 60
        for j in (0, 1):
            before = text(80)
            docs[2 * k + j], place[2 * k + j] = " ".join(before + passage + text(70)), len(passage)
    got = substring_dup.repeated_passages(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.start <= 84 and r.n_words >= place[r.doc_id] - 8 and r.removed == (r.doc_id % 2 == 1)}
    assert len(found) >= 0.99 * len(docs) and found >= set(range(760, 800))
    # a paragraph at an end may be like the other one without being equal
    whole = {r.doc_id for r in got if 70 <= r.start <= 80 and 131 <= r.start + r.n_words <= 141}
    assert len(whole & set(range(760))) >= 0.99 * 760


# --- 6 ---


def spans_by_hand(text):
    out = []
    rules = [("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for order, (kind, pattern, group, least) in enumerate(rules):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets_against_a_full_scan(spark, sf, texts):
    extra = ["TOKEN = \"abcdef\" and toKen:12345 passwdé=secret=abc/def", "é😀 AKIA" + "Q" * 16 + " " + "0a" * 15, "ſecret = abcdefgh Key api_Key=abcdefgh", "a" * 23 + "g" + "f" * 24, "secret secret: 'x' password=  qwertyuiop"]
    rows = spark.createDataFrame([*texts.items(), *((10**6 + k, t) for k, t in enumerate(extra))], "doc_id long, text string")
    for r in secrets.scan_secrets(rows).collect():
        text = texts.get(r.doc_id) if r.doc_id < 10**6 else extra[r.doc_id - 10**6]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in ("assign", "access", "hex")] == spans_by_hand(text)


def test_queries_follow_from_expressions():
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    for rule in secrets.RULES:
        index = secrets.TrigramIndex([b"nothing here"], secrets._trigrams(secrets.trigram_query(rule.pattern)))
        assert len(index.candidates(secrets.trigram_query(rule.pattern))) == (rule.kind == "hex")


def test_redaction_keeps_rows_and_columns(spark, odd):
    assert secrets.scan_secrets(odd).count() == odd.count()
    rows = odd.withColumn("text", F.when(F.col("doc_id") == 5, "my token = abcdef123 end").otherwise(F.col("text")))
    got = {r.doc_id: r for r in secrets.redact_secrets(rows).filter("doc_id is not null").collect()}
    assert got[5].text == "my [ASSIGN] end" and got[5].n_chars == 15 and got[1].text is None and got[2].text == ""
    assert secrets.redact_secrets(rows).columns == odd.columns and secrets.redact_secrets(rows.limit(0)).count() == 0


# --- 7 ---


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) * 5 for k, v in attention_lm.start_weights().items()}
    inputs = rng.integers(0, 60, (3, attention_lm.WINDOW))
    targets, told = rng.integers(0, 40, (3, attention_lm.HALF)), rng.random((3, attention_lm.HALF)) < 0.7
    base = rng.random((targets.size, attention_lm.GROUPS)), rng.random((targets.size, attention_lm.MEMBERS))
    loss = lambda: attention_lm.loss_and_gradient(w, inputs, base, targets, told)
    _, g = loss()
    for name in w:
        at = (int(inputs[0, 0]), 3) if name == "e" else (int(targets[0, 0]) // attention_lm.MEMBERS, 3, 2) if name == "member" else tuple(rng.integers(0, s) for s in w[name].shape)
        w[name][at] += 1e-5
        up = loss()[0]
        w[name][at] -= 2e-5
        down = loss()[0]
        w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6


def toy_classes(rng):
    counts = rng.integers(0, 50, attention_lm.IDS).astype(float)
    unit, share, klass = attention_lm.groups(counts)
    u = len(klass)
    first, last = rng.random(u) * 9, rng.random(attention_lm.CLASSES) * 9
    return attention_lm.Classes(counts, first, last, rng.random((attention_lm.CLASSES, u)) * 9, rng.random((attention_lm.CLASSES, u)) * 9, (unit, share, klass))


def test_probabilities_of_the_next_id_add_up_to_one():
    classes = toy_classes(np.random.default_rng(2))
    per_unit = np.exp(classes.group[:, classes.klass // attention_lm.MEMBERS] + classes.member[:, classes.klass // attention_lm.MEMBERS, classes.klass % attention_lm.MEMBERS] + classes.units)
    assert np.allclose(per_unit.sum(axis=1), 1, atol=1e-4)
    assert np.allclose(np.bincount(classes.unit, np.exp(classes.share), len(classes.klass)), 1, atol=1e-4)


def test_windowed_scores_equal_plain_attention():
    rng = np.random.default_rng(3)
    classes, lengths = toy_classes(rng), np.array([1, 15, 16, 17, 40, 100])
    w = {k: v * 6 for k, v in attention_lm.start_weights().items()}
    ids = rng.integers(0, attention_lm.IDS, lengths.sum()).astype(np.int32)
    layout = attention_lm.lay_out(ids, lengths, classes.unit)
    got = attention_lm.id_scores(attention_lm.scoring_tables(w, classes), ids, layout, classes, block=3)
    end, half, k = int(classes.unit[attention_lm.END]), attention_lm.HALF, 0
    for n in lengths:
        units = [end] * (half + 1) + classes.unit[ids[k : k + n]].tolist()
        for i in range(n):
            start = i // half * half
            before = np.array(units[start : half + i + 1])
            x = w["e"][before] + w["p"][: len(before)]
            a = np.exp((x[-1] @ w["q"]) @ (x @ w["k"]).T / np.sqrt(attention_lm.WIDTH))
            h = w["e"][before[-1]] + (a / a.sum()) @ (x @ w["v"])
            last, own = classes.klass[before[-1]], classes.unit[ids[k + i]]
            g, m = divmod(int(classes.klass[own]), attention_lm.MEMBERS)
            want = classes.units[last, own] + classes.share[ids[k + i]]
            for logits, target in ((h @ w["group"] + classes.group[last], g), (h @ w["member"][g] + classes.member[last, g], m)):
                want += logits[target] - np.log(np.exp(logits).sum())
            assert abs(got[k + i] - want) < 1e-3
        k += n


def test_attention_helps_on_texts_that_it_did_not_learn_from(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents")
    taught = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    model = attention_lm.fit(docs, taught)
    blind = attention_lm.Model(**{**vars(model), "weights": {k: v * (k not in ("group", "member")) for k, v in model.weights.items()}})
    mean = lambda m: attention_lm.score_texts(docs.filter(~taught), m).selectExpr("sum(score) / sum(n_tokens) as s").first().s
    assert 0 < model.mixture < 1 and mean(model) > mean(blind) + 0.02


def test_language_model(spark, sf, texts):
    got = attention_lm.op7_attention_lm(spark, sf).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count, ends = Counter(), 0
    for i, t in texts.items():
        if not held(i):
            count.update(words(t))
            ends += 1
    n, v = count.total() + ends, len(count) + 1
    for r in got:
        c = [count[w] for w in words(texts[r.doc_id])] + [ends]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(c), sum(x > 0 for x in c), n, held(r.doc_id))
        assert abs(r.base_score - np.log10((np.array(c) + 1) / (n + v + 1)).sum()) < 1e-6 * abs(r.base_score)
        assert r.score < 0


def test_language_model_cases(spark, odd):
    usable = F.col("doc_id").isNotNull()
    score = lambda docs, usable: attention_lm.score_texts(docs, attention_lm.fit(docs, usable))
    got = {r.doc_id: r for r in score(odd, usable).filter("doc_id is not null").collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[7].n_tokens == 30_001 and abs(got[1].score - got[2].score) < 1e-9
    assert all(np.isfinite(r.score) for r in score(odd, F.lit(False)).collect())
    assert score(odd.limit(0), usable).count() == 0


# --- 8 ---


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(600), random.randrange(600)) for _ in range(350)] + [(k, k + 1) for k in range(700, 730)]
    up = list(range(800))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in {x for a, b in edges if a != b for x in (a, b)}}


def test_near_duplicates_against_brute_force(spark, sf, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    for r in near_dup.op8_min_max_hashing(spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_near_duplicates_cases(spark, odd):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component) for r in near_dup.near_duplicates(odd, 2).collect())
    assert [(i, c) for i, _, c in got if i] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7), (8, 7)]
    kept = near_dup.keep_first(odd, 2)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7]
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(100)] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("component").distinct().count()
    assert got == 1


# --- 9 ---


def test_packing(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    extra = {10**6: " two  spaces\n\n next \t x \n y ", 10**6 + 1: "'s it's a b <|endoftext|> 12 34", 10**6 + 2: "x" * 20000, 10**6 + 3: ""}
    everything = texts | extra
    rows = packing.pack_documents(spark.createDataFrame(list(everything.items()), "doc_id long, text string")).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in everything.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    parts = len({s >> 40 for s in sequences})
    assert len(sequences) * packing.CAPACITY - sum(r.length for r in rows) < 2 * packing.CAPACITY * parts


def test_packing_balances_costs(spark, odd):
    assert len({r.doc_id for r in packing.pack_documents(odd).collect()}) == 9 and packing.pack_documents(odd.limit(0)).count() == 0
    lengths = [1500, 700, 600, 500, 400, 300, 60, 36]
    pieces = packing.pack(lengths)
    assert sorted(sum(p[2] for p in pieces if p[0] == k) for k in range(8)) == sorted(lengths) and {p[3] for p in pieces} == {0, 1}


# --- 10 ---


def test_fingerprints(spark, texts, sf):
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprint.op10_locally_consistent(spark, sf).collect()}
    print_of = lambda t: fingerprint.fingerprints_of([t.encode()])[0]
    for k, i in enumerate(ids):
        a, b = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.as_hex(print_of(a)) and r.edited_fingerprint == fingerprint.as_hex(print_of(edited))
        assert r.near_next == fingerprint.likeness(print_of(a), print_of(b)) and r.near_edited == fingerprint.likeness(print_of(a), print_of(edited))
    assert np.mean([r.near_edited for r in got.values()]) > 0.2 > 0.05 > np.mean([r.near_next for r in got.values()])


def test_equal_substrings_share_their_phrases():
    rnd = random.Random(10)
    text = "".join(rnd.choices("abcdefgh \n", k=20_000)).encode()
    for shift in (1, 2, 7, 100):
        a, b = (set(fingerprint.phrase_sets([t])[0].tolist()) for t in (text, b"z" * shift + text))
        assert len(a & b) > 0.97 * len(a)
    a, b = fingerprint.phrase_sets([b"aaaaaaaaaaaa" * 50, b""])
    assert len(a) >= 1 and len(b) == 0 and fingerprint.likeness(a, b) == 0 and fingerprint.likeness(b, b) == 1


def test_fingerprint_cases(spark, odd):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == odd.count() and fingerprint.fingerprints(odd.limit(0)).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    alone = fingerprint.fingerprints(odd.filter("doc_id = 4")).first()
    assert alone.near_next == 1 and alone.n_chars == 3


def test_windows_of_several_sizes_are_hashed_in_one_chain():
    draw = np.random.default_rng(5)
    for n in (0, 1, 4, 5, 8, 40):
        x = draw.integers(1, 1 << 62, n).astype(np.uint64)
        got = {size: h.tolist() for size, h in growing(x, [5, 6, 8])}
        assert got == {size: shingles(x, size).tolist() for size in (5, 6, 8) if n >= size}


def test_windows_of_texts_together_are_those_of_each_alone(spark, monkeypatch):
    texts = ["Ann has 5 km to go. Ben has 7 of them, and Carl 3!", "", "one two three four five six", "Then Ann met Ben at the old house of Carl", None, "5 km Ann -- and Ben of nine more words in here", "a b c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for sizes in (None, [5, 8]):
        got = []
        for together in (1, 64):
            monkeypatch.setattr(decontam, "TOGETHER", together)
            got.append(sorted(map(str, decontam.windows(rows, "id", "text", sizes, None).collect())))
        assert got[0] == got[1] and got[0]
