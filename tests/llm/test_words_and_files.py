"""Collocations, token files and spelling variants against brute-force versions, and their odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laborlens.llm import phrases, spelling, token_files
from laborlens.llm.common import table

SCHEMA = "doc_id long, text string, lang string, n long, word string, phrase string"


def frame(spark, rows):
    """rows of (id, text, lang), with columns whose names the operators use."""
    return spark.createDataFrame([(*r, 7, "w", "p") for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(4)
    words = ["the", "of", "new york", "new york city", "Straße", "über alles", "c++", "x"]
    text = lambda n: rng.choice(["", ". ", " ", "\n"]).join([""]) + " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\t", ";", "\n", ".  "]) for _ in range(n))
    rows = [(i, text(40), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    return [*rows, rows[3], rows[3], (None, text(30), "en"), (None, None, None), (98, "", "en"), (99, None, "de"), (100, text(3000), "en"), (101, ". , .", "en"), (102, "the", "fr")]


# --- 11 ---


def plain_collocations(rows, least, longest, covered=50):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in some.items():
        if any(100 * b >= covered * a for (g, q), b in some.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        s, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], s))
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "block"), [(10, 3, 1 << 19), (3, 4, 40)])
def test_collocations_equal_a_plain_version(spark, least, longest, block, monkeypatch):
    for name, n in (("WORDS", 500), ("SHARD", 700), ("HELD", 40), ("CHUNKS", 3000)) if least == 3 else ():
        monkeypatch.setattr(phrases, name, n)
    rows = odd_rows()
    got = phrases.mine(frame(spark, rows), least=least, longest=longest, block=block).collect()
    want = plain_collocations(rows, least, longest)
    assert len(want) > 20 and sorted(map(tuple, got)) == want


def test_collocations_equal_their_sql(spark, sf):
    from tests.compare import database, differences

    assert not differences(phrases.op11_trie_collocations(spark, sf), database(sf), phrases.SQL)


def test_collocations_of_nothing(spark):
    assert phrases.mine(frame(spark, [])).count() == 0
    assert phrases.mine(frame(spark, [(1, "a b", None)])).count() == 0


def test_large_products_stay_exact(spark):
    big = 10**13 + 7
    p = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    w = spark.createDataFrame([("en", "a", big + 3), ("en", "b", big + 11)], "lang string, phrase string, a long")
    t = spark.createDataFrame([("en", 4 * big)], "lang string, n long")
    assert phrases.scored(p, w, t).first()["score"] == 1000000 * big * big // ((big + 3) * (big + 11))


@pytest.mark.parametrize(("n", "vocabulary"), [(1, 3), (400, 20), (5000, 900)])
def test_tries_find_their_phrases_and_no_others(n, vocabulary):
    rng = np.random.default_rng(n)
    names = rng.integers(1, 2**63, vocabulary, dtype=np.uint64)
    held = sorted({tuple(names[np.minimum(rng.zipf(1.3, rng.integers(2, 4)), vocabulary) - 1].tolist()) for _ in range(n)})
    trie = phrases.Trie([np.array(p, np.uint64) for p in held])
    text = names[np.minimum(rng.zipf(1.3, 4000), vocabulary) - 1]
    text[::50] = 0
    runs = Counter(tuple(text[i : i + k].tolist()) for k in (2, 3) for i in range(len(text) - k + 1))
    assert trie.count(text, np.flatnonzero(text), 3).tolist() == [runs[p] for p in held]


# --- 12 ---


def plain_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("length", "file_tokens"), [(2048, 1 << 24), (16, 300)])
def test_token_files_hold_the_ids_of_the_tokenizers_library(spark, tmp_path, length, file_tokens):
    rows = [*odd_rows(), (200, "a <|endoftext|> b  c\n\n d", "en"), (201, "日本   é" * 50, "en")]
    path = f"file://{tmp_path}/f"
    token_files.write_files(frame(spark, rows), path, length=length, file_tokens=file_tokens)
    got = token_files.with_starts(token_files.read_files(spark, path)).orderBy("start").collect()
    ids = {(i, t): plain_ids(t) for i, t, _ in rows}
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, *_ in rows if i is not None)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(ids[i, t]), digest(ids[i, t])) for i, t, _ in rows)
    # any sequence of any file, as a view of the mapped file
    files = sorted((tmp_path / "f").glob("part-*"))
    assert len(files) > 3 if length == 16 else files
    whole = {}
    for f in (f for f in files if f.stat().st_size):
        with pa.memory_map(str(f)) as mapped, pa.ipc.open_file(mapped) as file:
            n = sum(file.get_batch(k).num_rows for k in range(file.num_record_batches))
            parts = [token_files.sequence(file, k) for k in range(n)]
            assert all(len(a) == len(m) == length and a.dtype == np.uint16 and not a.flags.owndata for a, m in parts)
            parts = [(a, m.to_numpy(zero_copy_only=False)) for a, m in parts]
            assert all(m.all() for _, m in parts[:-1])
            told = {k.decode(): int(v) for k, v in file.schema.metadata.items()}
            whole[told["shard"], told["part"]] = np.concatenate([a[m] for a, m in parts])
    strung = np.concatenate([whole[k] for k in sorted(whole)])
    assert [digest(strung[r.start : r.start + r.n_tokens]) for r in got] == [r.ids_crc32 for r in got]


def test_token_files_of_nothing_and_of_ids_that_do_not_fit(spark, tmp_path):
    token_files.write_files(frame(spark, []), f"file://{tmp_path}/n")
    assert token_files.with_starts(token_files.read_files(spark, f"file://{tmp_path}/n")).count() == 0
    with pytest.raises(Exception, match="is no uint8"):
        token_files.write_files(frame(spark, [(1, "some words", "en")]), f"file://{tmp_path}/u", kind="uint8")


def test_files_that_disagree_with_themselves_are_refused():
    data = token_files.arrow_file(np.arange(10, dtype=np.uint16), [1, 2], pa.int64(), np.array([4, 6]), 4, 0, 0)
    assert token_files._documents(pa.ipc.open_file(data)).column("n_tokens").to_pylist() == [4, 6]
    file = pa.ipc.open_file(data)
    batch = file.get_batch(0).replace_schema_metadata(file.schema.metadata | {b"tokens": b"11"})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    with pytest.raises(ValueError, match="the file says 11"):
        token_files._documents(pa.ipc.open_file(sink.getvalue()))


# --- 13 ---


def plain_counts(rows, damaged=199, least=5):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % damaged == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(n):
    by = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n.get(form[w])))
    return sorted(out)


def variants_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("max_group", [spelling.MAX_GROUP, 2, 20])
def test_variants_equal_all_pairs(spark, max_group):
    rng = random.Random(max_group)
    n = {}
    for _ in range(250):
        w = "".join(rng.choice("aé") for _ in range(rng.randint(6, 9)))
        n[w] = rng.choice([5, 6, 30, 150, 800, 4000])
    for w in list(n)[:60]:
        i = rng.randrange(len(w))
        n[w[:i] + rng.choice("abzÿ") + w[i:]] = rng.choice([5, 30, 150])
        n[w[:i] + rng.choice("abz") + w[i + 1 :]] = rng.choice([5, 30, 150])
    n |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_variants(n)
    assert sum(w[4] > 2 for w in want) > 50 and any(w[1] != w[2] and w[1] for w in want)
    assert variants_of(spelling.variants(words, max_group=max_group)) == want


def test_words_of_texts_equal_a_plain_version(spark):
    rng = random.Random(9)
    runs = ["Straßen", "naïveté", "ÀÉÎÕÜß", "running", "abcdef", "abcde", "x×y÷z", "tōkyōtō", "STRASSEN"]
    rows = [(i, rng.choice(["\n", " ", "9", "-"]).join(rng.choice(runs) + rng.choice(["", "s", "ed"]) for _ in range(50))) for i in range(80)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (1000, None), (1001, ""), (1002, "running " * 30_000)]
    df = frame(spark, [(i, t, None) for i, t in rows])
    got = {r.word: r.n for r in spelling.count_words(df, damaged=7).collect()}
    assert got == plain_counts(rows, damaged=7) and len(got) > 30
    assert spelling.count_words(frame(spark, [])).count() == 0
    assert spelling.variants(spelling.count_words(frame(spark, []))).count() == 0


def test_variants_of_the_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    n = plain_counts(rows)
    assert variants_of(spelling.op13_edit_composition(spark, sf)) == plain_variants(n)
    assert all(n.get(w) == k for w, k in spelling.count_words(table(spark, sf, "documents").withColumn("word", F.lit("clash"))).collect())
