"""Repeated passages: paragraph MinHash banding.

Passages are pasted anywhere, so paragraphs are cut by content: after a word whose pair with the next one has the least
hash among RADIUS pairs to either side; short pieces on end, as of periodic text, are put together. Equal passages are cut alike
except for RADIUS words at their ends, and what lies before the first cut and after the last. A paragraph's
set is its five-word shingles; equal sets are one paragraph. Band keys (min-max values of the set) and the set's own hash go through one
aggregation that tells which keys several paragraphs share and which paragraphs several documents hold; only those are
made again, through a Bloom filter. Colliding paragraphs are verified by exact Jaccard similarity in the rounds of
near_dup.link_rounds, which never expands a group into pairs, and components are the clusters of removals: the smallest id
of a cluster keeps its paragraph. Where a paragraph's neighbour
isn't repeated, the words up to that one's far end are compared word by word with what stands beside the paragraph in the first and the last
document that have such an end there too, and those that are equal belong to the repeat. Words on end make a run; runs of fewer than LEAST_WORDS words are left alone, and longer ones are told in parts that the document keeps and parts that go.

tune() picks the bands: two rows and four bands find 98 % of pairs of similarity 0.8 and all equal ones.

Cases: null and empty texts and texts of fewer than five words have no paragraph; null ids can't be named and are left
out; rows that repeat an id are one document, so that they don't repeat each other; a paragraph that repeats inside one
document alone stays; an empty table gives no row; further columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import _C3, U64, WordHashes, bloom, drop_stored, hash_spots, in_bloom, mix, permutations, raw, shingles, slices, stored, table
from laborlens.llm.near_dup import link_rounds

SIZE = 5
RADIUS = 4
PERCENT = 80
LEAST_WORDS = 16
ROWS = 2
SEED = 5
#: Low bits of a key tell what it is: band keys end in 1, paragraphs' own hashes in 0.
_ONE = U64(1)


#: Smaller sets have no unequal set of similarity 0.8.
LEAST_SET = 4


@dataclass
class Cut:
    """Paragraphs of SIZE words or more: text, first word, words, and hash of the set; all sets' distinct shingles one
    after the other, where each begins and how many it has; the texts' words, where in them each begins, and how many words before
    and after it an equal passage could hold without holding the neighbour."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    own: np.ndarray
    sets: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    at: np.ndarray
    before: np.ndarray
    after: np.ndarray


def tune(rows: int = ROWS, similarity: float = PERCENT / 100, recall: float = 0.98) -> int:
    """The fewest bands that find pairs of the similarity with the recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


BANDS = tune()


class Paragraphs:
    """Cuts texts into paragraphs and hashes them; many texts lie in one array, so that numpy has long rows."""

    def __init__(self):
        self.words = WordHashes()
        self.mult, self.add = permutations(-(-ROWS * BANDS // 2), SEED)

    def cut(self, texts: list[bytes]) -> Cut:
        with np.errstate(over="ignore"):
            words = [t.lower().split() for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words))
            x = self.words([w for ws in words for w in ws])
            begin = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(n)), n)
            inner = np.ones(len(x), bool)
            inner[(begin + n - 1)[n > 0]] = False
            at = np.flatnonzero(inner)
            # RADIUS pairs of highest hash stand between texts, so that no text sees another
            spot = at + RADIUS * (owner[at] + 1)
            pair = mix(x[at] * _C3 + x[at + 1])
            around = np.full(len(x) + RADIUS * (len(n) + 2), np.iinfo(U64).max, U64)
            around[spot] = pair
            low, width, full = around, 1, 2 * RADIUS + 1
            while 2 * width <= full:
                low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
            low = np.minimum(low[: len(around) - full + 1], low[full - width :][: len(around) - full + 1])
            first = np.zeros(len(x), bool)
            first[begin[n > 0]] = True
            first[at[pair == low[spot - RADIUS]] + 1] = True
            starts = np.flatnonzero(first)
            lengths = np.diff(starts, append=len(x))
            doc = owner[starts]
            short = np.flatnonzero((lengths < SIZE) & (starts > begin[doc]))
            whole = np.ones(len(starts), bool)
            last, held = -2, SIZE
            for k in short.tolist():
                joins = k == last + 1 and held < SIZE
                whole[k] = not joins
                last, held = k, held * joins + int(lengths[k])
            starts = starts[whole]
            lengths, doc = np.diff(starts, append=len(x)), doc[whole]
            keep = np.flatnonzero(lengths >= SIZE)
            doc, starts, lengths = doc[keep], starts[keep], lengths[keep]
            ends = starts + lengths
            near = doc[1:] == doc[:-1]
            before, after = starts - begin[doc], (begin + n)[doc] - ends
            before[1:][near] = np.minimum(before[1:], starts[1:] - starts[:-1] + RADIUS + 1)[near]
            after[:-1][near] = np.minimum(after[:-1], ends[1:] - ends[:-1] + RADIUS + 1)[near]
            counts = lengths - SIZE + 1
            if not len(counts):
                none = np.zeros(0, np.int64)
                return Cut(none, none, none, np.zeros(0, U64), np.zeros(0, U64), none, none, x, none, none, none)
            unit = np.repeat(np.arange(len(counts)), counts)
            sets = shingles(x, SIZE)[np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts - starts, counts)]
            order = np.lexsort((sets, unit))
            unit, sets = unit[order], sets[order]
            new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (sets[1:] != sets[:-1])))
            unit, sets = unit[new], sets[new]
            counts = np.bincount(unit)
            begins = np.cumsum(counts) - counts
            own = mix(np.add.reduceat(mix(sets), begins) + counts.astype(U64)) & ~_ONE
            return Cut(doc, starts - begin[doc], lengths, own, sets, begins, counts, x, starts, before, after)

    def keys(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs large enough to be like an unequal one, and their band keys, a row for each."""
        with np.errstate(over="ignore"):
            large = np.flatnonzero(cut.counts >= LEAST_SET)
            if not len(large):
                return large, np.zeros((0, BANDS), U64)
            values = []
            for m, a in zip(self.mult, self.add, strict=True):
                h = cut.sets * m + a
                values += [np.minimum.reduceat(h, cut.begins)[large], np.maximum.reduceat(h, cut.begins)[large]]
            out = np.empty((len(large), BANDS), U64)
            for band in range(BANDS):
                key = np.full(len(large), mix(np.array([band + 1], U64) * _C3)[0], U64)
                for v in values[band * ROWS : (band + 1) * ROWS]:
                    key = mix(key * _C3 + v)
                out[:, band] = key | _ONE
            return large, out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), raw(text_col).alias("text"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, low, high): band keys that paragraphs low and high share, and paragraphs that documents low and high hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Paragraphs()
        for b in slices(batches):
            cut = cutter.cut(b.column(1).to_pylist())
            large, banded = cutter.keys(cut)
            keys = [banded.ravel(), cut.own]
            values = [np.repeat(cut.own[large].view(np.int64), BANDS), b.column(0).to_numpy()[cut.doc]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(values))], names=["key", "value"])

    found = rows.mapInArrow(run, "key bigint, value bigint").groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return found.filter("low < high")


def candidates(rows: DataFrame, filter_: np.ndarray) -> DataFrame:
    """(id, n, keys, words, low, high) of each paragraph with a key in the filter; low and high are documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Paragraphs()
        for b in slices(batches):
            cut = cutter.cut(b.column(1).to_pylist())
            large, keys = cutter.keys(cut)
            live = in_bloom(filter_, hash_spots(filter_, keys.ravel())).reshape(keys.shape)
            hit = np.flatnonzero(live.any(axis=1))
            out = [large[hit], [keys[k][live[k]].view(np.int64) for k in hit.tolist()], [cut.sets[cut.begins[k] : cut.begins[k] + cut.counts[k]].view(np.int64) for k in large[hit].tolist()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cut.own[out[0]].view(np.int64)), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64())), pa.array(b.column(0).to_numpy()[cut.doc[out[0]]])], names=["id", "keys", "words", "doc"]
            )

    found = rows.mapInArrow(run, "id bigint, keys array<bigint>, words array<bigint>, doc bigint")
    return found.groupBy("id").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.min("doc").alias("low"), F.max("doc").alias("high"))


def occurrences(rows: DataFrame, filter_: np.ndarray, equal: np.ndarray) -> DataFrame:
    """(doc, start, n_words, id, left, right) of each paragraph in the filter; left and right: 32-bit hashes of the words beside it,
    nearest first, and whether the paragraph stands there once more; null where another paragraph is of which equal ones are known (a filter, too;
    one that is only like others may end elsewhere than those), or the text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Paragraphs()
        for b in slices(batches):
            cut = cutter.cut(b.column(1).to_pylist())
            hit = np.flatnonzero(in_bloom(filter_, hash_spots(filter_, cut.own)))
            columns = [b.column(0).to_numpy()[cut.doc[hit]], cut.start[hit], cut.length[hit], cut.own[hit].view(np.int64)]
            sides = [pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(again)], names=["words", "again"]) for words, again in beside(cut, hit, in_bloom(equal, hash_spots(equal, cut.own)))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *sides], names=["doc", "start", "n_words", "id", "left", "right"])

    side = "struct<words: binary, again: boolean>"
    return rows.mapInArrow(run, f"doc bigint, start bigint, n_words bigint, id bigint, left {side}, right {side}")


def beside(cut: Cut, hit: np.ndarray, known: np.ndarray) -> list[tuple[list[bytes | None], np.ndarray]]:
    """What stands before and after each paragraph in hit if it isn't a known one, and whether it is the same one again, as in periodic text, which
    may begin and end elsewhere in another document."""
    words = (cut.words >> U64(32)).astype(np.uint32)
    joined = (cut.doc[1:] == cut.doc[:-1]) & (cut.at[1:] == cut.at[:-1] + cut.length[:-1])
    again = joined & (cut.own[1:] == cut.own[:-1])
    out = []
    for side, edge, many in ((0, cut.at, cut.before), (1, cut.at + cut.length, cut.after)):
        here, skip = np.zeros((2, len(known)), bool)
        to, other = (slice(1, None), known[:-1]) if side == 0 else (slice(None, -1), known[1:])
        here[to], skip[to] = again, joined & ~again & other
        ends = zip(edge[hit].tolist(), many[hit].tolist(), skip[hit].tolist(), strict=True)
        told = [None if skip or not n else (words[at : at + n] if side else words[at - n : at][::-1]).tobytes() for at, n, skip in ends]
        out.append((told, here[hit]))
    return out


def extensions(held: DataFrame) -> DataFrame:
    """(doc, at, side, k, first): how many words before (side 0) or after a paragraph's edge are equal to those in the first or
    the last document with such an edge, and the smaller document of both; for the first one's, the most that any other shares with it."""
    edges = F.array(*(F.struct(F.lit(k).alias("side"), at.alias("at"), F.col(f"{name}.words").alias("words"), F.col(f"{name}.again").alias("again")) for k, name, at in ((0, "left", F.col("start")), (1, "right", F.col("start") + F.col("n_words")))))
    edges = stored(held.select("doc", "component", F.inline(edges)).filter("words is not null"), "op5-edges")
    edge, again = F.struct("doc", "at", "words"), F.col("again").cast("int")
    ends = edges.groupBy("component", "side").agg(F.min_by(edge, F.struct(1 - again, "doc", "at")).alias("low"), F.max_by(edge, F.struct(again, "doc", "at")).alias("high"), F.min("doc").alias("one"), F.max("doc").alias("two"))
    ends = ends.filter("one < two").drop("one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            k = [[0 if y is None else _common(x, y) for x, y in zip(words, b.column(i).to_pylist(), strict=True)] for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3, b.num_columns)), *(pa.array(x, pa.int64()) for x in k)], names=[*b.schema.names[3:], "k_low", "k_high"])

    both = edges.filter("not again").join(ends, ["component", "side"])
    other = lambda end: F.when(F.col("doc") != F.col(f"{end}.doc"), F.col(f"{end}.words")).alias(end)
    both = both.select("words", other("low"), other("high"), "component", "doc", "side", "at", F.col("low.doc").alias("first"), F.col("low.at").alias("place"), F.col("high.doc").alias("last"))
    told = both.mapInArrow(run, "component bigint, doc bigint, side int, at bigint, first bigint, place bigint, last bigint, k_low bigint, k_high bigint")
    told = stored(told.filter("k_low > 0 or k_high > 0"), "op5-extended")
    own = told.filter("k_low > 0").groupBy("component", "side", "first", "place").agg(F.max("k_low").alias("k")).select(F.col("first").alias("doc"), F.col("place").alias("at"), "side", "k", "first")
    nearest = F.when(F.col("k_low") >= F.col("k_high"), F.col("first")).otherwise(F.col("last"))
    return told.select("doc", "at", "side", F.greatest("k_low", "k_high").alias("k"), F.least("doc", nearest).alias("first")).unionByName(own)


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y)) // 4
    same = np.frombuffer(x, np.uint32, n) == np.frombuffer(y, np.uint32, n)
    return n if same.all() else int(same.argmin())


def parts(doc: int, spans: list[dict], least_words: int) -> list[tuple[int, int, int, bool]]:
    """(start, words, first, removed) of a document's runs, told in parts that it keeps and parts that go. Paragraphs tell
    more than the words beside them, and what is kept more than what goes."""
    state = np.zeros(max(s["stop"] for s in spans) + 2, np.int8)
    first = np.full(len(state), np.iinfo(np.int64).max)
    for s in sorted(spans, key=lambda s: (s["whole"], s["first"] == doc, -s["first"])):
        state[s["start"] + 1 : s["stop"] + 1] = 1 + (s["first"] != doc)
        first[s["start"] + 1 : s["stop"] + 1] = s["first"]
    out = []
    edges = np.flatnonzero(np.diff((state > 0).astype(np.int8)))
    for i, j in edges.reshape(-1, 2).tolist():
        if j - i >= least_words:
            cuts = [i, *(i + 1 + np.flatnonzero(np.diff(state[i + 1 : j + 1]))).tolist(), j]
            out += [(a, b - a, int(first[a + 1 : b + 1].min()), bool(state[a + 1] == 2)) for a, b in zip(cuts, cuts[1:])]
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, start, n_words, first_id, removed) of each part of a run of repeated paragraphs; start counts words. first_id: the
    smallest document that holds one of them; removed: whether they are kept elsewhere, which all of a part have in common."""
    rows = _rows(docs, id_col, text_col)
    shared = stored(shared_keys(rows), "op5-shared")
    banded = shared.filter("key % 2 <> 0").select("key")
    exact = shared.filter("key % 2 = 0").select(F.col("key").alias("id"), "low", "high")

    found = stored(candidates(rows, bloom(banded, "key", hashed=True)), "op5-candidates")
    keys = found.select(F.col("id").alias("rep"), F.size("words").alias("n"), F.explode("keys").alias("key"))
    live = stored(keys.join(banded, "key"), "op5-live")
    none = found.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    label = link_rounds(live, found.select("id", "words"), none, percent, "op5")

    linked = label.join(found.select("id", "low", "high"), "id")
    first = linked.groupBy("component").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    linked = linked.join(first, "component").select("id", "first", "component", (F.col("low") < F.col("high")).alias("equal"))
    alone = exact.join(label.select("id"), "id", "left_anti").select("id", F.col("low").alias("first"), F.col("id").alias("component"), F.lit(True).alias("equal"))
    repeated = stored(alone.unionByName(linked), "op5-repeated")

    for done in (shared, live, found):
        drop_stored(done)

    found = occurrences(rows, bloom(repeated, "id", hashed=True), bloom(repeated.filter("equal"), "id", hashed=True))
    held = stored(found.join(repeated.drop("equal"), "id"), "op5-held")
    span = lambda start, stop, first, whole: F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), first.alias("first"), F.lit(whole).alias("whole"))
    beyond = F.col("at") + F.when(F.col("side") == 0, -F.col("k")).otherwise(F.col("k"))
    more = extensions(held).select("doc", span(F.least("at", beyond), F.greatest("at", beyond), F.col("first"), False).alias("span"))
    spans = held.select("doc", span(F.col("start"), F.col("start") + F.col("n_words"), F.col("first"), True).alias("span")).unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [(doc, *part) for doc, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for part in parts(doc, found, least_words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc", "start", "n_words", "first_id", "removed"])

    out = spans.groupBy("doc").agg(F.collect_set("span")).mapInArrow(run, "doc bigint, start bigint, n_words bigint, first_id bigint, removed boolean")
    return out.withColumnRenamed("doc", id_col)


def op5_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
