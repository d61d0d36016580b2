"""Token counts of a unigram tokenizer without making tokens.

An Aho-Corasick automaton over the vocabulary gives all pieces that end at each character; a dynamic programme carries, for
each end, the best score, the number of pieces on the best path and whether its last one is unknown. No path is kept.
Ties go as in the `tokenizers` library's Unigram model: of equal scores at one end the longest piece stays; a character that is
no piece of its own costs the lowest score less UNKNOWN; neighbouring unknown characters are one token. Words are what
lies between ASCII white space, each with the word mark before it; a word's result is kept while it recurs.

Cases: null and empty texts and texts of white space count 0; null ids stay; repeated rows get a row each; an empty table
gives no row; further columns are ignored; texts and words of any length are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from laborlens.llm.common import raw, slices, table

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = 10.0
MARK = "▁"
#: Words per generation of the cache; two generations are held.
WORDS = 250_000


def zipf_vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """The ordinary pieces of a public vocabulary, scored as log probabilities by Zipf's law over their ranks: public files
    hold merges, not unigram scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(ordinary))))
    return [(model.id_to_piece(i), -math.log(k + 1) - total) for k, i in enumerate(ordinary)]


class Viterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN

    def __call__(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        score, count, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, at, unknown = None, 0, False
            for length, value in sorted(ends[end - 1], reverse=True):
                total = value + score[end - length]
                if best is None or total > best:
                    best, at = total, end - length
            if text[end - 1] not in self.single:
                total = self.unknown + score[end - 1]
                if best is None or total > best:
                    best, at, unknown = total, end - 1, True
            score[end], last[end] = best, unknown
            count[end] = count[at] + (not (unknown and last[at]))
        return count[n], score[n]


class WordCounts(dict):
    """word -> (pieces, score)."""

    def __init__(self, viterbi: Viterbi):
        super().__init__()
        self.viterbi, self.old = viterbi, {}

    def __missing__(self, word: bytes) -> tuple[int, float]:
        got = self.old.get(word) or self.viterbi(MARK + word.decode("utf-8", "replace"))
        if len(word) > 64:
            return got
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


_counts: dict[str, WordCounts] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_words, n_tokens, log_score) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_counts(vocabulary)
        for b in slices(batches):
            words, tokens, scores = [], [], []
            for text in b.column(1).to_pylist():
                got = list(map(known.__getitem__, text.split()))
                words.append(len(got))
                tokens.append(sum(c for c, _ in got))
                scores.append(math.fsum(s for _, s in got))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=[id_col, "n_words", "n_tokens", "log_score"])

    return docs.select(id_col, raw(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, log_score double")


def word_counts(vocabulary: str) -> WordCounts:
    """One automaton and cache for all tasks that a worker runs."""
    if vocabulary not in _counts:
        _counts[vocabulary] = WordCounts(Viterbi(zipf_vocabulary(vocabulary)))
    return _counts[vocabulary]


def op3_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
