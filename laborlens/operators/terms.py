"""Dictionary terms of words and symbols (c++, node.js, machine learning) in texts.

Each text is read once by an automaton of the terms (a trie with failure links), inside Arrow batches, so that nothing but mentions leaves a
task and cost follows the text and not the dictionary. The dictionary goes to the tasks in blocks of at most BLOCK terms, one pass each; a
dictionary of any size is therefore bounded in what is broadcast and in what a worker holds.

A mention isn't part of a larger word: no word character stands beside it. Terms marked `inside` may stand anywhere. Mentions of one term don't overlap.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from laborlens.session import stored

#: Terms of one automaton: some 50 MB of a worker's memory.
BLOCK = 200_000
#: Texts that are turned into Python objects at once.
ROWS = 512

#: Fixed value: terms of anything but letters A to Z, digits and blanks may stand inside a word.
PLAIN = r"^[a-zA-Z0-9\s]+$"

Span = tuple[int, int, str]
#: A term in a text: how often, and where first.
Told = tuple[str, int, int, int]


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_" or (c > "˿" and unicodedata.category(c)[0] == "M")


class _Words(dict):
    """Whether a character is one of a word."""

    def __missing__(self, c: str) -> bool:
        got = self[c] = is_word(c)
        return got


_word = _Words()


@functools.lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, bool], ...]) -> ahocorasick.Automaton:
    """To be made once a task: to find it again, all terms are hashed."""
    out = ahocorasick.Automaton()
    for term, inside in terms:
        out.add_word(term, (term, inside, len(term)))
    out.make_automaton()
    return out


def spans(known: ahocorasick.Automaton, text: str) -> Iterator[Span]:
    """(start, end, term) of every place where a term may stand, by end."""
    n, word = len(text), _word
    for last, (term, inside, size) in known.iter(text):
        end = last + 1
        start = end - size
        if inside or not ((start and word[text[start - 1]]) or (end < n and word[text[end]])):
            yield start, end, term


def _counted(known: ahocorasick.Automaton, text: str) -> list[Told]:
    """Mentions apart, counted. Places of one term come in their order, as all are of one length, so nothing is sorted."""
    out: dict[str, list[int]] = {}
    for start, end, term in spans(known, text):
        got = out.get(term)
        if got is None:
            out[term] = [1, start, end, end]
        elif start >= got[3]:
            got[0] += 1
            got[3] = end
    return [(term, n, start, end) for term, (n, start, end, _) in out.items()]


def _first(found: Iterator[Span]) -> list[Told]:
    """Mentions, counted as they are."""
    out: dict[str, list[int]] = {}
    for start, end, term in found:
        out.setdefault(term, [0, start, end])[0] += 1
    return [(term, *v) for term, v in out.items()]


def leftmost_longest(found: Iterator[Span]) -> Iterator[Span]:
    """The longest term at the first place where one stands, and on from behind it."""
    free = 0
    for start, end, term in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= free:
            free = end
            yield start, end, term


def _blocks(terms: DataFrame, block: int) -> Iterator[Broadcast]:
    """The dictionary in bounded parts."""
    inside = F.col("inside") if "inside" in terms.columns else F.lit(False)
    known = terms.select("term", inside.alias("inside")).filter("term <> '' and term = trim(term)").groupBy("term").agg(F.bool_or("inside").alias("inside"))
    n = -(-known.count() // block)
    dealt = known.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(max(n, 1))))
    for k in range(n):
        part = dealt.filter(F.col("block") == k).select("term", "inside").collect()
        if part:
            yield terms.sparkSession.sparkContext.broadcast(tuple(sorted((r.term, bool(r.inside)) for r in part)))


def _told(keys: pa.RecordBatch, found: list[list[Told]], names: list[str]) -> pa.RecordBatch:
    """A row for each text and term: how often it stands there, and the first place."""
    held = keys.take(pa.array([k for k, told in enumerate(found) for _ in told], pa.int64()))
    told = list(chain.from_iterable(found))
    columns = [pa.array([x[i] for x in told], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*held.columns, *columns], names=[*names, "term", "n", "start", "end"])


def mentions(texts: DataFrame, terms: DataFrame, longest: bool = False, block: int = BLOCK) -> DataFrame:
    """(..., term, n, start, end): a row for each text and term that stands in it, how often, and where first, in code points of the text in lower case.
    texts(..., text), terms(term in lower case, perhaps inside boolean). longest: where terms overlap, only the longest of the leftmost counts."""
    keys = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    rows = texts.select(*keys, F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    blocks = _blocks(terms, block)
    if longest:
        return _longest(rows, keys, kinds, list(blocks))
    out = None
    for shared in blocks:
        found = rows.mapInArrow(_matcher(keys, _counted, shared), f"{kinds}, term string, n bigint, start int, end int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.limit(0).select(*keys, F.lit("").alias("term"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return out


def held(text: Column, terms: DataFrame, block: int = BLOCK) -> Column:
    """Terms that stand in a text, once each, in their order: mentions() as a list beside the text, so that nothing is joined."""

    def of(shared: Broadcast) -> Column:
        @F.pandas_udf("array<string>")
        def find(texts: pd.Series) -> pd.Series:
            known = _automaton(shared.value)
            return pd.Series([[x[0] for x in _counted(known, text)] for text in texts], dtype=object)

        # said to be indeterminate, as a filter on it would otherwise move below and find the terms again
        return find.asNondeterministic()(F.coalesce(F.lower(text), F.lit("")))

    return F.sort_array(F.concat(F.array().cast("array<string>"), *map(of, _blocks(terms, block))))


def _matcher(keys: list[str], find: Callable, shared: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automaton(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                found = [find(known, text) for text in b.column("text").to_pylist()]
                yield _told(b.select(keys), found, keys)

    return run


SPANS = "array<struct<start:int,end:int,term:string>>"


def _longest(rows: DataFrame, keys: list[str], kinds: str, blocks: list[Broadcast]) -> DataFrame:
    """With one block in one go. With more, each block's places are kept beside the text, and the last pass chooses among them."""
    told = f"{kinds}, term string, n bigint, start int, end int"
    if len(blocks) == 1:
        return rows.mapInArrow(_matcher(keys, lambda known, text: _first(leftmost_longest(spans(known, text))), blocks[0]), told)
    held = rows.withColumn("spans", F.lit(None).cast(SPANS))
    kind = to_arrow_type(held.schema["spans"].dataType)
    for shared in blocks:

        def add(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            known = _automaton(shared.value)
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    b = whole.slice(i, ROWS)
                    more = [[*(before or []), *({"start": s, "end": e, "term": t} for s, e, t in spans(known, text))] for text, before in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(more, kind)], names=b.schema.names)

        held = stored(held.mapInArrow(add, f"{kinds}, text string, spans {SPANS}"), "spans")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                found = [_first(leftmost_longest((x["start"], x["end"], x["term"]) for x in row or [])) for row in b.column("spans").to_pylist()]
                yield _told(b.select(keys), found, keys)

    return held.drop("text").mapInArrow(choose, told)


def inside_words(term: Column) -> Column:
    """Whether a term may stand inside a word."""
    return ~term.rlike(PLAIN)
