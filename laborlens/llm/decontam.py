"""Benchmark decontamination by templates.

Tokens are words less their outer punctuation, case-folded; numbers, units after a number and names (capitalised words
that don't begin a sentence) become typed placeholders. Every run of WINDOW tokens of a benchmark item (all of a shorter
one) is a window in three forms: with all placeholders, with names literal (case tells names, and a copy may have another case)
and all literal, so that verbatim text always counts. Windows of items and documents are joined on their hashes; forms with
fewer literal tokens than placeholders say nothing. What fills the placeholders is compared along each alignment (document
position minus item position): equal fillings must stand for equal ones, and different names for different names, which a
re-parameterised question keeps and chance matches don't; two values may become the same. Where fillings disagree, the one at
most places holds, none if several have as many, and only windows with the others are left out. A document is contaminated by
an item if the windows that are left cover LEAST of its tokens.

Documents' windows go through a Bloom filter of the items' windows inside the tasks (bounded whatever the benchmark's
size), then through an exact hash join, so a benchmark of any size will do.

Cases: null and empty texts and items match nothing; items of fewer than SHORTEST tokens are too short to tell and match
nothing; null ids are kept out of the result; rows that repeat an id count as one document or item; an empty table gives
no row; further columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import CACHE, U64, bloom, growing, hash_spots, in_bloom, raw, slices, table

WINDOW = 8
SHORTEST = 5
LEAST = 0.5
#: Texts whose windows are hashed at once.
TOGETHER = 64

PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
UNITS = frozenset(
    "mm cm m km in ft yd mi miles mile metres meters inches feet yards mg g kg lb lbs oz tons grams kilograms pounds ounces ml l litres liters gallons"
    " s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year percent dollars dollar cents euros euro"
    " km/h mph degrees degree kw kwh watts volts".split()
)
CAP, ENDS, IS_NUMBER, IS_UNIT = (U64(1 << k) for k in range(4))
FLAGS = U64(15)
#: Placeholders for a number, a name and a unit.
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = (U64(x) << U64(4) for x in (1, 2, 3))


class Tokens(dict):
    """word -> hash of its case-folded core in the upper 60 bits, flags below; 0 for words of punctuation alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip(PUNCTUATION)
        if not core:
            got = 0
        else:
            text = core.decode("utf-8", "replace")
            number = bool(NUMBER.fullmatch(text))
            got = xxhash.xxh3_64_intdigest(text.casefold().encode()) | 64
            got &= ~15
            got |= (text[:1].isupper() and not text[1:].isupper()) * int(CAP) | (word.rstrip(b"\"')]*%&$#")[-1:] in b".!?:" and word[-1:] != core[-1:]) * int(ENDS)
            got |= number * int(IS_NUMBER) | (text.lower() in UNITS) * int(IS_UNIT)
        self[word] = got
        return got

    def forms(self, texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[bytes], np.ndarray]:
        """The different forms of texts, one after the other (token hashes, whether each is a placeholder), which tokens are names, the words, and each one's text."""
        split = [text.split() for text in texts]
        words, row = list(chain.from_iterable(split)), np.repeat(np.arange(len(split)), [len(s) for s in split])
        x = np.fromiter(map(self.__getitem__, words), U64, len(words))
        if len(x) and not x.all():
            keep = np.flatnonzero(x)
            x, row, words = x[keep], row[keep], [words[k] for k in keep.tolist()]
        before = np.concatenate((np.array([ENDS], U64), x[:-1]))[: len(x)]
        before[1:][row[1:] != row[:-1]] = ENDS
        number = (x & IS_NUMBER) != 0
        name = ~number & ((x & CAP) != 0) & ((before & ENDS) == 0)
        unit = ~number & ((x & IS_UNIT) != 0) & ((before & IS_NUMBER) != 0)
        literal = x & ~FLAGS
        values = np.where(number, NUMBER_SLOT, np.where(unit, UNIT_SLOT, literal))
        value = number | unit
        out = [(literal, np.zeros(len(x), bool))]
        if value.any():
            out.append((values, value))
        if name.any():
            out.append((np.where(name, NAME_SLOT, values), value | name))
        return out, name, words, row


def agreed(hits: list[tuple[int, int, list, list]]) -> tuple[list[int], int, bool]:
    """Of an alignment's windows (position, size, the item's and the document's fillings): places of the item that the
    consistent ones cover, their distinct fillings in the item, and whether all fillings are the item's."""
    shown = {(p + s["at"], s["name"], s["word"], o["word"]) for p, _, slots, own in hits for s, o in zip(slots, own, strict=True)}
    places = Counter(f[1:] for f in shown)
    most: dict[tuple, list[int]] = {}
    for (name, x, y), n in places.items():
        for side in [(0, name, x)] + [(1, name, y)] * name:
            most.setdefault(side, []).append(n)

    def holds(side: tuple, n: int) -> bool:
        return n == max(most[side]) and most[side].count(n) == 1

    held = {f for f, n in places.items() if holds((0, f[0], f[1]), n) and (not f[0] or holds((1, True, f[2]), n))}
    covered, xs = set(), set()
    for p, size, slots, own in hits:
        fills = {(s["name"], s["word"], o["word"]) for s, o in zip(slots, own, strict=True)}
        if fills <= held:
            covered.update(range(p, p + size))
            xs |= {f[:2] for f in fills}
    return sorted(covered), len(xs), all(x == y for _, x, y in places)


SCHEMA = "hash bigint, id bigint, pos int, size int, n_tokens int, slots array<struct<at: int, name: boolean, word: string>>"
SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("name", pa.bool_()), ("word", pa.string())]))
PLACES = "doc bigint, item bigint, n int, places array<int>, slots int, verbatim boolean"


def windows(rows: DataFrame, id_col: str, text_col: str, sizes: list[int] | None, words_in: np.ndarray | None) -> DataFrame:
    """Windows of each row in all forms: hash, id, position, size, the row's tokens and what fills the placeholders.

    sizes None: of WINDOW tokens, or all of a shorter text. words_in: a Bloom filter that the hashes must pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, every = Tokens(), list(range(SHORTEST, WINDOW + 1)) if sizes is None else sizes
        for b in slices(batches, TOGETHER):
            out, docs = [], b.column(0).to_pylist()
            forms, name, words, row = tokens.forms(b.column(1).to_pylist())
            many = np.bincount(row, minlength=len(docs))
            begin = np.cumsum(many) - many
            last: dict[int, np.ndarray] = {}
            for template, slot in forms:
                ahead = np.concatenate(([0], np.cumsum(slot)))
                for size, hashes in growing(template, every):
                    # inside one text, with enough literal tokens; forms that are the same here give one window
                    told = (row[: len(hashes)] == row[size - 1 :]) & (2 * (ahead[size:] - ahead[:-size]) <= size)
                    if sizes is None:
                        told &= np.minimum(many, WINDOW)[row[: len(hashes)]] == size
                    if size in last:
                        told &= hashes != last[size]
                        last[size] = np.where(told, hashes, last[size])
                    else:
                        last[size] = hashes
                    at = np.flatnonzero(told)
                    if words_in is not None and len(at):
                        at = at[in_bloom(words_in, hash_spots(words_in, hashes[at]))]
                    for p, h in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True):
                        k = int(row[p])
                        fill = [{"at": j, "name": bool(name[p + j] and slot[p + j]), "word": words[p + j].strip(PUNCTUATION).decode("utf-8", "replace").casefold()} for j in np.flatnonzero(slot[p : p + size]).tolist()]
                        out.append((h, docs[k], p - int(begin[k]), size, int(many[k]), fill))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), SLOTS), strict=True)], names=["hash", "id", "pos", "size", "n_tokens", "slots"])

    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), raw(text_col).alias("text")).mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc id, item id, coverage, slots, verbatim): one row for each document and item that contaminates it. verbatim: the
    placeholders hold what they hold in the item."""
    items = windows(benchmark, item_col, item_text, None, None).distinct()
    sizes = sorted({WINDOW, *(r.size for r in items.select("size").distinct().collect())})
    theirs = windows(docs, id_col, text_col, sizes, bloom(items, "hash", hashed=True))
    a = theirs.select("hash", "size", F.col("id").alias("doc"), F.col("pos").alias("at"), F.col("slots").alias("own"))
    b = items.select("hash", "size", F.col("id").alias("item"), "pos", "n_tokens", "slots")
    hits = a.join(b, ["hash", "size"]).withColumn("shift", F.col("at") - F.col("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [agreed([(h["pos"], h["size"], h["slots"], h["own"]) for h in hits]) for hits in b.column(3).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.list_(pa.int32()), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], names=["doc", "item", "n", "places", "slots", "verbatim"])

    aligned = hits.groupBy("doc", "item", "shift").agg(F.max("n_tokens").alias("n"), F.collect_set(F.struct("pos", "size", "slots", "own")).alias("hits"))
    covered = aligned.select("doc", "item", "n", "hits").mapInArrow(run, PLACES).withColumn("place", F.explode("places"))
    out = covered.groupBy("doc", "item").agg((F.count_distinct("place") / F.max("n")).alias("coverage"), F.max("slots").alias("slots"), F.max("verbatim").alias("verbatim"))
    return out.filter(F.col("coverage") >= least).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "coverage", "slots", "verbatim")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the contaminated ones; rows with a null id stay."""
    gone = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti").select(*docs.columns)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
