"""Groups of spelling variants, by composition of finite-state machines.

Two words are near if one inserted, deleted or replaced code point parts them. Pairs are the paths of A o T o A: A is the minimised
acceptor of a set of words, T the transducer that makes exactly one edit. A state of the composition is (q, 0, q) before the edit, as both
sides have read the same, and (p, 1, q) behind it, from where both sides must read the same to the end. States are made as they are
reached and what follows them is kept, so common endings are walked through once.

The composition is partitioned by the state that it is in after SHARED symbols. Words have twice as many at least, so an edit behind the first
SHARED leaves equal beginnings, and any other edit equal endings: the pairs of the second kind are found by composing the reversed words,
and told once, as those whose beginnings differ. A partition of more than MAX_GROUP words is split by its next symbol. That loses only
pairs whose edit is at that very symbol, which meet by what is left without it; as the missing symbol and the rest name the
word, at most as many words meet as the alphabet has letters.

Cases: null and empty texts have no words; null ids count as the text `null` in the rule that damages words; repeated rows count each; a tie
of counts goes to the smaller word; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import CACHE, drop_stored, slices, stored, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
DAMAGED = 199
#: A form has so many times its variant's occurrences.
RATIO = 5
SHARED = LEAST_LENGTH // 2
#: Words of a partition of the composition that one task holds.
MAX_GROUP = 100_000

#: Latin-1 bytes: A-Z to a-z, letters kept, all others to spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case; a run whose crc32 with its document's id is a multiple of `damaged` lacks a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            columns = [pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # one byte a code point; others than Latin-1 become "?", which is no letter
                runs = text.encode("latin-1", "replace").translate(_LETTERS).split() if text else ()
                state = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(w for w in runs if len(w) >= least_length).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), state)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    found[word] += n
            if len(found) > CACHE:
                yield told()
        if found:
            yield told()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """Minimised acceptor of words that come sorted. State 0 is the initial one; follow[q] maps symbols to states."""

    def __init__(self, words: list[str]):
        self.follow: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(depth: int) -> None:
            # states below depth won't change any more: each becomes the equal one that is there already
            while len(path) > depth + 1:
                q = path.pop()
                same = known.setdefault((self.final[q], *self.follow[q].items()), q)
                if same != q:
                    self.follow[path[-1]][last[len(path) - 1]] = same

        for word in words:
            shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            settle(shared)
            for c in word[shared:]:
                self.follow.append({})
                self.final.append(False)
                self.follow[path[-1]][c] = len(self.follow) - 1
                path.append(len(self.follow) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)


class OneEdit:
    """Acceptor o one-edit transducer o acceptor. pairs() tells each unordered pair once."""

    def __init__(self, acceptor: Acceptor):
        self.follow, self.final = acceptor.follow, acceptor.final
        self.endings: dict[tuple[int, int], list[str]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}
        self.leads: dict[int, bool] = {}

    def behind(self, p: int, q: int) -> list[str]:
        """What (p, 1, q) still accepts on both sides."""
        key = (p, q) if p < q else (q, p)
        got = self.endings.get(key)
        if got is None:
            got = self.endings[key] = self._common(p, q, "")
        return got

    def _common(self, p: int, q: int, but: str) -> list[str]:
        a, b = self.follow[p], self.follow[q]
        out = [""] if self.final[p] and self.final[q] else []
        for c in a.keys() & b.keys():
            if c != but:
                out += [c + s for s in self.behind(a[c], b[c])]
        return out

    def at(self, q: int) -> list[tuple[str, str]]:
        """Pairs of what follows (q, 0, q) with the edit right here. A deletion counts at the end of a run of equal symbols only."""
        got = self.edits.get(q)
        if got is None:
            got, steps = [], list(self.follow[q].items())
            for i, (a, p) in enumerate(steps):
                for b, r in steps[:i]:
                    got += [(a + s, b + s) for s in self.behind(p, r)]
                got += [(a + s, s) for s in self._common(p, q, a)]
            self.edits[q] = got
        return got

    def leading(self, q: int) -> bool:
        """Whether an edit is possible at q or later."""
        got = self.leads.get(q)
        if got is None:
            got = self.leads[q] = any([self.leading(r) for r in self.follow[q].values()]) or bool(self.at(q))
        return got

    def pairs(self) -> Iterator[tuple[str, str]]:
        todo = [("", 0)]
        while todo:
            head, q = todo.pop()
            if self.leading(q):
                for a, b in self.at(q):
                    yield head + a, head + b
                todo += [(head + c, r) for c, r in self.follow[q].items()]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (back, start, rest, n), sorted: every partition's pairs, both ways, as (word, other, other_n)."""
    key, held = None, {}
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "other", "other_n"])

    def group() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        back, start = key
        for a, b in OneEdit(Acceptor(list(held))).pairs():
            u, v = start + a, start + b
            if back:
                u, v = u[::-1], v[::-1]
                if u[:SHARED] == v[:SHARED]:
                    continue  # told by the words' beginnings
            out.extend([(u, v, held[b]), (v, u, held[a])])
            if len(out) > 50_000:
                yield told()

    for batch in batches:
        for back, start, rest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (back, start):
                yield from group()
                key, held = (back, start), {}
            held[rest] = n
    yield from group()
    yield told()


def near_words(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(word, other, other_n) for all near words of words(word, n), both ways. Words have LEAST_LENGTH code points or more."""
    both = words.select(F.explode(F.array(*(F.struct(F.lit(back).alias("back"), w.alias("w"), "n") for back, w in ((False, F.col("word")), (True, F.reverse("word")))))).alias("e")).select("e.*")
    size, found, left = SHARED, [], both
    while True:
        left = left.withColumn("start", F.substring("w", 1, size))
        hot = left.groupBy("back", "start").agg(F.count("*").alias("k")).filter(F.col("k") > max_group).select("back", "start")
        whole = hot.isEmpty()
        now = left if whole else left.join(hot, ["back", "start"], "left_anti")
        now = now.select("back", "start", F.expr(f"substring(w, {size + 1})").alias("rest"), "n")
        found.append(now.repartition("back", "start").sortWithinPartitions("back", "start", "rest").mapInArrow(_compose, "word string, other string, other_n bigint"))
        if whole:
            break
        left = stored(left.join(hot, ["back", "start"], "left_semi").select("back", "w", "n"), "op13-hot")
        found.append(_edited_at(left, size))
        left = left.filter(F.length("w") > size)
        size += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _edited_at(rows: DataFrame, size: int) -> DataFrame:
    """Pairs that agree in exactly `size` symbols from their start: they meet by what is left without the next one."""
    without = F.expr(f"concat(substring(w, 1, {size}), substring(w, {size + 2}))")
    keys = F.array(*(F.struct(key.alias("key"), lost.alias("lost"), "w", "n") for key, lost in ((F.col("w"), F.lit(None).cast("string")), (without, F.expr(f"substring(w, {size + 1}, 1)")))))
    cut = rows.select("back", F.explode(keys).alias("e")).select("back", "e.*").filter("lost is null or lost <> ''")
    met = cut.groupBy("back", "key").agg(F.collect_list(F.struct("lost", "w", "n")).alias("all")).filter(F.size("all") > 1)
    pairs = met.select("back", F.col("all"), F.explode("all").alias("x")).select("back", "x", F.explode("all").alias("y")).filter("x.w <> y.w")
    # a deletion counts only where the next symbol of the shorter word is another one
    pairs = pairs.filter(f"substring(x.w, {size + 1}, 1) <> substring(y.w, {size + 1}, 1)")
    forward = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    named = pairs.select("back", forward("x.w").alias("word"), forward("y.w").alias("other"), F.col("y.n").alias("other_n"))
    return named.filter(f"not back or substring(word, 1, {SHARED}) <> substring(other, 1, {SHARED})").select("word", "other", "other_n")


def variants(words: DataFrame, ratio: int = RATIO, max_group: int = MAX_GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of words(word, n)."""
    near = near_words(words, max_group).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    told = words.join(near, "word", "left").withColumn("is", -F.col("best.m") >= ratio * F.col("n"))
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("is"), F.col("best.w")).alias("form"), F.when(F.col("is"), -F.col("best.m")).alias("form_n"))
    told = stored(told, "op13-forms")
    # counts grow by `ratio` from form to form, so there are no circles and chains are short; each round doubles what a step covers
    step = stored(told.filter("form is not null").select("word", F.col("form").alias("to")), "op13-roots")
    while True:
        further = step.join(step.select(F.col("word").alias("to"), F.col("to").alias("beyond")), "to", "left")
        new = stored(further.select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "op13-roots")
        moved = not new.filter("moved").isEmpty()
        drop_stored(step)
        step = new.select("word", "to")
        if not moved:
            break
    return told.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op13_edit_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(count_words(table(spark, sf_dir, "documents")), "op13-words"))
