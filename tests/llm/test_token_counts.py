import random

from tokenizers import Tokenizer
from tokenizers.models import Unigram

from laborlens.llm.token_counts import MARK, Viterbi, count_tokens, op3_count_viterbi, zipf_vocabulary


def reference(vocabulary):
    return Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))


def test_counts_are_the_librarys_on_words():
    vocabulary = zipf_vocabulary()
    viterbi, other = Viterbi(vocabulary), reference(vocabulary)
    random.seed(1)
    letters = "eaonthris éßñ中😀-.,'0🙂"
    words = ["".join(random.choices(letters, k=random.randint(1, 30))) for _ in range(3000)] + ["a" * 500, "😀😀x😀", "▁"]
    for w in words:
        assert viterbi(MARK + w)[0] == len(other.encode(MARK + w, add_special_tokens=False).ids), w


def test_ties_go_to_the_longest_piece():
    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("abab", -4.0), ("c", -0.5)]
    viterbi, other = Viterbi(vocabulary), reference(vocabulary)
    random.seed(2)
    for _ in range(500):
        w = "".join(random.choices("abcx", k=random.randint(1, 12)))
        assert viterbi(w)[0] == len(other.encode(w, add_special_tokens=False).ids), w


def test_cases(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \t\n", 5), (None, "a b", 5), (4, "a b", 5), (4, "a b", 5), (5, "xyz " * 5000, 5)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_words): r.n_tokens for r in count_tokens(rows).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == 0 and got[None, 2] == got[4, 2] > 0 and got[5, 5000] % 5000 == 0
    assert count_tokens(rows).count() == 7 and count_tokens(rows.limit(0)).count() == 0


def test_query_on_documents(spark, sf):
    from laborlens.llm.common import table

    other = reference(zipf_vocabulary())
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in op3_count_viterbi(spark, sf).collect():
        assert r.n_tokens == sum(len(other.encode(MARK + w.decode(), add_special_tokens=False).ids) for w in (texts[r.doc_id] or "").encode().split())
