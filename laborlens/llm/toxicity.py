"""Toxicity by nearest labelled examples.

Terms are all words that two examples have. A term's weight is its TF-IDF times
how much it leans to label 1 among the examples, from LEAST_LEAN to 1: with IDF alone neighbours share a text's
subject, not its tone (held-out recall 0.55 on sf0.1). Document frequencies are counted over all documents. The NEIGHBOURS
examples of highest cosine are found exactly with an inverted index in blocks: a block's bound is the sum over the text's terms of the
largest weight in the block; the blocks of the highest bounds are read first, then those whose bounds reach the last
neighbour, and the rest skipped. Votes are weighted by distance; a monotone fit of leave-one-out votes to the labels turns them into scores.
Texts without any term get the share of label 1 among examples.

The index is bounded by MAX_LABELLED rows (lowest hashes of their ids) whatever the input; it is the only thing broadcast.

Cases: null and empty texts have no term and are scored as such; null ids are scored and counted as not held out; an id
with several labels has the largest; other labels than 0 and 1, and null ones, are ignored; without labels every score is
0.5; repeated rows get a row each; equal cosines go to the smaller example id; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import CACHE, crc_mod, drop_stored, slices, stored, table

MAX_LABELLED = 4096
MIN_SUPPORT = 2
LEAST_LEAN = 0.05
#: Standard deviations beyond which a term counts in full.
FULL_LEAN = 10.0
NEIGHBOURS = 7
BLOCK = 128
#: Blocks that are read at once before any bound is compared.
FIRST_BLOCKS = 4
REJECT = 0.7
PUNCTUATION = ".,;:!?\"'()[]{}*&%$#|-_"


class TermIds(dict):
    """word -> its place in the vocabulary, -1 for others."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.ids = {t: k for k, t in enumerate(vocabulary)}

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = self.ids.get(word.strip(PUNCTUATION), -1)
        return got

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the text, ascending, and how often each occurs."""
        words = Counter(text.lower().split())
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        times = np.fromiter(words.values(), np.int64, len(words))
        terms, at = np.unique(ids[ids >= 0], return_inverse=True)
        return terms, np.bincount(at, times[ids >= 0], len(terms))


@dataclass
class Model:
    vocabulary: list[str]
    #: IDF times lean.
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: (example, terms, weights) of each example, its number being its place.
    vectors: list[tuple[np.ndarray, np.ndarray]]
    without: float
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    #: Postings by term and example: examples and weights, where each term's part of each block begins, and each block's largest weight.
    example: np.ndarray = field(init=False)
    posted: np.ndarray = field(init=False)
    cuts: np.ndarray = field(init=False)
    bounds: np.ndarray = field(init=False)

    def __post_init__(self):
        v, blocks = len(self.weight), -(-len(self.ids) // BLOCK)
        none = np.zeros(0, np.int64)
        terms = np.concatenate([none, *(t for t, _ in self.vectors)])
        example = np.repeat(np.arange(len(self.vectors)), [len(t) for t, _ in self.vectors])
        posted = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        order = np.argsort(terms, kind="stable")
        terms, self.example, self.posted = terms[order], example[order].astype(np.int32), posted[order]
        cell = terms * (blocks + 1) + self.example // BLOCK
        self.cuts = np.searchsorted(cell, np.arange(v * (blocks + 1))).reshape(v, blocks + 1).astype(np.int32)
        bounds = np.zeros(v * (blocks + 1))
        np.maximum.at(bounds, cell, self.posted)
        self.bounds = np.nextafter(bounds.reshape(v, blocks + 1)[:, :blocks].astype(np.float32), np.float32(2))
        self.bounds[bounds.reshape(v, blocks + 1)[:, :blocks] == 0] = 0
        self.base = (self.labels.sum() + 1) / (len(self.labels) + 2)
        self.vectors = []

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the nearest, exactly."""
        bound = weights @ self.bounds[terms]
        order = np.argsort(-bound, kind="stable")
        e, c = self._scored(terms, weights, order[:FIRST_BLOCKS], skip)
        rest = order[FIRST_BLOCKS:]
        rest = rest[bound[rest] >= (c[-1] - 1e-9 if len(c) == NEIGHBOURS else 1e-300)]
        if len(rest):
            more = self._scored(terms, weights, rest, skip)
            e, c = np.concatenate((e, more[0])), np.concatenate((c, more[1]))
            best = np.lexsort((self.ids[e], -np.round(c, 12)))[:NEIGHBOURS]
            e, c = e[best], c[best]
        return e, c

    def _scored(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The best examples of these blocks and their cosines."""
        begin, end = self.cuts[terms[:, None], blocks], self.cuts[terms[:, None], blocks + 1]
        size = (end - begin).ravel()
        at = np.repeat(begin.ravel() - np.cumsum(size) + size, size) + np.arange(size.sum())
        scores = np.bincount(self.example[at], np.repeat(np.repeat(weights, len(blocks)), size) * self.posted[at], len(self.ids))
        if skip >= 0:
            scores[skip] = 0
        e = np.flatnonzero(scores > 0)
        if len(e) > 4 * NEIGHBOURS:
            least = np.partition(scores[e], len(e) - NEIGHBOURS)[len(e) - NEIGHBOURS]
            e = e[scores[e] >= least - 1e-9]
        best = np.lexsort((self.ids[e], -np.round(scores[e], 12)))[:NEIGHBOURS]
        return e[best], scores[e[best]]

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        e, c = self.nearest(terms, weights, skip)
        w = 1 / (1.05 - np.minimum(c, 1.0))
        return float((w * self.labels[e]).sum() / w.sum()) if len(e) else self.base, e, c

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Pools adjacent violators over leave-one-out votes; a pool's value is smoothed by half a row of each label and holds at its
        mean vote, with straight lines between."""
        got = sorted((self.vote(t, w, k)[0], int(self.labels[k])) for k, (t, w) in enumerate(vectors) if len(t))
        pools: list[list[float]] = []
        for v, y in got:
            pools.append([y, 1, v])
            while len(pools) > 1 and (pools[-2][2] / pools[-2][1] == pools[-1][2] / pools[-1][1] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.knots = (np.array([v / n for _, n, v in pools]), np.maximum.accumulate([(y + 0.5) / (n + 1) for y, n, _ in pools]))

    def score(self, counted: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[int], list[float]]:
        terms, counts = counted
        if not len(terms) or not len(self.ids):
            return self.without, [], []
        v, e, c = self.vote(terms, self.vector(terms, counts))
        return float(np.interp(v, *self.knots)), [int(self.ids[k]) for k in e[:3]], [float(x) for x in c[:3]]


def _counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, toxic, terms, counts) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermIds(vocabulary)
        for b in slices(batches):
            got = [terms.counts(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[k].astype(np.int32) for g in got], pa.list_(pa.int32())) for k in (0, 1))], names=["id", "toxic", "terms", "counts"])

    return docs.mapInArrow(run, "id bigint, toxic int, terms array<int>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Model:
    """usable: a condition on labels' rows that may be learned from."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.lit(True) if usable is None else usable).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    # an id may be repeated: of its rows each text counts once, and the bound holds for rows
    labelled = rows.join(F.broadcast(known), "id").select("id", "toxic", "text").distinct()
    labelled = stored(labelled.orderBy(F.xxhash64("id", "text"), "id", "text").limit(MAX_LABELLED), "op4-labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            count = {0: Counter(), 1: Counter()}
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                # the empty term stands for the rows themselves
                count[y].update({w.strip(PUNCTUATION) for w in set((t or "").lower().split())} | {""})
            terms = sorted(count[0].keys() | count[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array([count[y][t] for t in terms], pa.int64()) for y in (0, 1))], names=["term", "n0", "n1"])

    counts = labelled.mapInArrow(seen, "term string, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.filter((F.col("n0") + F.col("n1") >= MIN_SUPPORT) | (F.col("term") == "")).orderBy("term").toArrow()
    vocabulary, n1 = counts["term"].to_pylist(), counts["n1"].to_numpy().astype(float)
    held = n1 + counts["n0"].to_numpy()
    total, share = (held[0], n1[0] / held[0]) if len(held) else (0.0, 0.0)
    vocabulary, n1, held = vocabulary[1:], n1[1:], held[1:]
    lean = (n1 - held * share) / np.sqrt(held * share * (1 - share) * (1 - held / max(1.0, total)) + 1)
    lean = np.clip(lean / FULL_LEAN, LEAST_LEAN, 1)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = TermIds(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                found = set(map(terms.__getitem__, set((t or "").lower().split())))
                found.discard(-1)
                n[list(found)] += 1
            n[-1] += b.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["term", "n"])

    found = np.zeros(len(vocabulary) + 1)
    got = rows.select("text").mapInArrow(present, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found[got["term"].to_numpy()] = got["n"].to_numpy()
    weight = (np.log((1 + found[-1]) / (1 + found[:-1])) + 1) * lean

    examples = _counted(labelled, vocabulary).toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    drop_stored(labelled)
    ids, toxic = examples["id"].to_numpy(), examples["toxic"].to_numpy().astype(float)
    counted = [(t.values.to_numpy().astype(np.int64), c.values.to_numpy()) for t, c in zip(examples["terms"], examples["counts"], strict=True)]
    without = (toxic.sum() + 1) / (len(toxic) + 2)
    model = Model(vocabulary, weight, ids, toxic, [], without)
    vectors = [(t, model.vector(t, c)) for t, c in counted]
    # examples that share common terms are put together, so that few blocks have high bounds for a text
    common = np.argsort(-found[:-1], kind="stable")[:64]
    place = np.full(len(vocabulary), len(common))
    place[common] = np.arange(len(common))
    kinds = np.array([place[t[np.argsort(-c, kind="stable")[:8]]].min(initial=len(common)) for t, c in counted], int)
    order = np.lexsort((np.arange(len(ids)), toxic, kinds))
    vectors = [vectors[k] for k in order]
    model = Model(vocabulary, weight, ids[order], toxic[order], vectors, without)
    model.calibrate(vectors)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence: ids and cosines of the nearest examples) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermIds(model.vocabulary)
        for b in slices(batches):
            got = [model.score(terms.counts(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=[id_col, "score", "evidence", "cosines"],
            )

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence array<bigint>, cosines array<double>")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = REJECT) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay as they are and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermIds(model.vocabulary)
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([model.score(terms.counts(t or ""))[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), usable=crc_mod("doc_id", 3) != 1)
    scored = score_toxicity(docs, model)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence", "cosines")
