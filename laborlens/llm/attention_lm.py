"""Language-model scores: a causal self-attention model over subword ids, in numpy, beside a unigram base.

A text is its words (between ASCII white space, A-Z lower-cased) and one end. Each word is the ids of a public byte-level
vocabulary for the word with a space before it; the end is that vocabulary's end id. The UNITS most frequent ids are units,
the others share a unit with those of like frequency; units are dealt into classes by frequency, and those into GROUPS groups of MEMBERS.
The attention model gives, from the WINDOW ids before, the probability of the next id's group and that of its class in the group, by two
learned softmaxes; times the unit's share of its class after the class before, times the id's share of its unit.

Gathered from all training documents: word counts, from them how often ids occur, begin and end words and follow each other inside
words, and how classes follow each other across words. The ids of training documents are written once for all that reads them. The attention is trained on the windows of all training documents, each once: documents are dealt by hash
to ROUNDS rounds and to tasks of some PART windows; each task takes a pass of Adam steps, and a round's weights are averaged, level by level.

Scoring: windows of WINDOW positions overlap by half; each position is scored once, in the window that has it in its second half, and
the first half is context; windows of many documents run as one masked batch. A word's probability is m times the model's
plus 1-m times its share of all training tokens; both add up to one over all words at most. m isn't fitted: a text's probability is the mean of those
under each of MIXTURES, so that no text costs more than the logarithm of their number over its best one.

Scores of the FREQUENT words are summed inside the tasks (a bounded table is sent there, which also takes out the hot
keys); other words are joined with the counts by a shuffle.

Cases: null and empty texts are the end alone; null ids are scored and counted as not held out, and aren't learned from; repeated rows get a
row each; without training documents all counts are 0 and the model is uniform over classes; further columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from laborlens.llm.common import crc_mod, drop_stored, raw, slices, stored, table
from laborlens.llm.packing import word_ids

VOCABULARY = "byte_bpe_50k.json"
IDS = 50_257
END = 50_256
GROUPS, MEMBERS = 16, 16
CLASSES = GROUPS * MEMBERS
TAIL_CLASSES = 32
UNITS = 2048
#: Ids beyond UNITS share these.
TAIL_UNITS = 32
WIDTH = 16
WINDOW = 32
HALF = WINDOW // 2
PART = 65_536
ROUNDS = 4
#: Windows of a step of Adam, at least and at most: as many as make a pass of some STEPS.
BATCH, MOST, STEPS = 64, 256, 256
#: Windows that are scored at once, and bytes of text; one text may have more.
SEGMENT, BYTES = 4096, 1 << 19
RATE = 0.02
FREQUENT = 100_000
#: Weight of marginal shares beside counts of pairs.
PRIOR = 20.0
COUNTED = 100_000
#: Words kept by a task before all but the frequent ones are dropped, and ids.
KEPT_WORDS, KEPT_IDS = 250_000, 2_000_000
MIXTURES = (0.1, 0.3, 0.5, 0.7, 0.9)

_OTHER_SPACE = re.compile(r"[^\S ]")
_UNSEEN = np.float32(-1e30)
_MASK = np.where(np.arange(WINDOW) <= HALF + np.arange(HALF)[:, None], np.float32(0), _UNSEEN)
_SCALE = np.float32(1 / math.sqrt(WIDTH))


_begins: list[np.ndarray] = []


def ids_of_words(words: list[bytes], encode: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and how many each has. Words are encoded by one call, as the vocabulary cuts texts at blanks and only first
    ids of words begin with one; words with white space of other kinds, which it may cut otherwise, one by one."""
    text = "".join(" " + w.decode("utf-8", "replace") for w in words)
    if _OTHER_SPACE.search(text):
        found = [encode(" " + w.decode("utf-8", "replace")) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size
    if not _begins:
        _begins.append(begins_word())
    ids = np.array(encode(text), np.int32)
    return ids, np.diff(np.flatnonzero(_begins[0][ids]), append=len(ids))


class Lexicon(dict):
    """word bytes -> place in arrays of first ids, numbers of ids and counts; counts of words that aren't frequent are nan."""

    def __init__(self, frequent: dict[bytes, int] | None = None):
        super().__init__()
        self.encode = word_ids(VOCABULARY).encode
        self.frequent = frequent or {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.size, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.empty(1 << 14)

    def _learn(self, words: list[bytes]) -> None:
        ids, size = ids_of_words(words, self.encode)
        more, at = len(ids), len(self)
        if self.used + more > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(len(self.flat), more), np.int32)))
        while at + len(words) > len(self.first):
            self.first, self.size, self.count = (np.concatenate((a, np.empty_like(a))) for a in (self.first, self.size, self.count))
        self.flat[self.used : self.used + more] = ids
        here = slice(at, at + len(words))
        self.first[here], self.size[here] = self.used + np.cumsum(size) - size, size
        self.count[here] = np.fromiter((self.frequent.get(w, math.nan) for w in words), float, len(words))
        self.used += more
        self.update(zip(words, range(at, at + len(words)), strict=True))

    def _forget(self) -> None:
        """All but the frequent words."""
        kept = [(w, k) for w, k in self.items() if w in self.frequent]
        old = np.array([k for _, k in kept], np.int64)
        first, size = self.first[old], self.size[old]
        flat = self.flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        self.clear()
        self.update((w, k) for k, (w, _) in enumerate(kept))
        self.flat, self.used = np.concatenate((flat, np.empty(1 << 16, np.int32))), len(flat)
        self.first[: len(old)], self.size[: len(old)], self.count[: len(old)] = np.cumsum(size) - size, size, self.count[old]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, one after the other; how many each word has; counts."""
        if len(self) > KEPT_WORDS or self.used > KEPT_IDS:
            self._forget()
        at = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = [words[k] for k in np.flatnonzero(at < 0).tolist()]
        if new:
            self._learn(list(dict.fromkeys(new)))
            at[at < 0] = np.fromiter(map(self.__getitem__, new), np.int64, len(new))
        size = self.size[at]
        ids = self.flat[np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return ids, size, self.count[at]


_lexicons: list[Lexicon] = []


def lexicon(frequent: dict[bytes, int] | None = None) -> Lexicon:
    """The one that the worker's last task had, if it knows the same frequent words."""
    if not _lexicons or _lexicons[0].frequent != (frequent or {}):
        _lexicons[:] = [Lexicon(frequent)]
    return _lexicons[0]


class Classes:
    """Units and classes of ids by frequency: the frequent ids are units, the frequent units classes of their own; the rest by ranges of
    like frequency. After class c, log probabilities: group[c, g] of a class of group g, member[c, g, m] of its class m, units[c, u] of unit u in its class."""

    def __init__(self, counts: np.ndarray, first: np.ndarray, last: np.ndarray, inside: np.ndarray, across: np.ndarray, of: tuple | None = None):
        """Counts of ids, of classes that end words, of units that begin them, of pairs (class, unit) inside words and across them."""
        self.unit, self.share, self.klass = of or groups(counts)
        mass = np.bincount(self.unit, counts + 1.0, UNITS + TAIL_UNITS)
        marginal = mass / mass.sum()
        begin = (first + marginal) / (first.sum() + 1)
        within = (inside + 1.0 * marginal) / (inside.sum(axis=1, keepdims=True) + 1)
        beyond = (across + PRIOR * begin) / (across.sum(axis=1, keepdims=True) + PRIOR)
        goes_on = (inside.sum(axis=1) / np.maximum(1e-9, inside.sum(axis=1) + last))[:, None]
        p = np.where((inside.sum(axis=1) + last)[:, None] > 0, goes_on * within + (1 - goes_on) * beyond, marginal)
        p = 0.999 * p + 0.001 * (marginal + 1e-9) / (1 + 1e-9 * len(marginal))
        member = np.zeros((len(self.klass), CLASSES))
        member[np.arange(len(self.klass)), self.klass] = 1
        of_class = p @ member
        of_group = of_class.reshape(CLASSES, GROUPS, MEMBERS).sum(axis=2)
        self.group = np.log(of_group).astype(np.float32)
        self.member = (np.log(of_class).reshape(CLASSES, GROUPS, MEMBERS) - np.log(of_group)[:, :, None]).astype(np.float32)
        self.units = (np.log(p) - np.log(of_class)[:, self.klass]).astype(np.float32)


def groups(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit of each id, log share of each id in its unit, class of each unit."""

    def deal(mass: np.ndarray, own: int, tail: int) -> np.ndarray:
        order = np.argsort(-mass, kind="stable")
        of = np.empty(len(mass), np.int32)
        of[order[:own]] = np.arange(own)
        rest = np.cumsum(mass[order[own:]])
        of[order[own:]] = own + np.minimum(tail - 1, (rest * tail / rest[-1]).astype(np.int32))
        return of

    mass = counts + 1.0
    mass[END] += mass.sum()  # the end is always a unit and a class of its own
    unit = deal(mass, UNITS, TAIL_UNITS)
    total = np.bincount(unit, mass, UNITS + TAIL_UNITS)
    return unit, np.log(mass / total[unit]).astype(np.float32), deal(total + 1e-9, CLASSES - TAIL_CLASSES, TAIL_CLASSES)


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    w = {"e": draw(UNITS + TAIL_UNITS, WIDTH), "p": draw(WINDOW, WIDTH), "group": draw(WIDTH, GROUPS), "member": draw(GROUPS, WIDTH, MEMBERS)}
    return w | {k: draw(WIDTH, WIDTH) for k in ("q", "k", "v")}


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp over the last axis, and its sums; shifted by the maximum only where plain values are too large or too small."""
    out = np.exp(x)
    total = np.matmul(out, np.ones((x.shape[-1], 1), x.dtype))
    if not (total.max(initial=1) < 1e30 and total.min(initial=1) > 1e-30):
        out = np.exp(x - x.max(axis=-1, keepdims=True))
        total = out.sum(axis=-1, keepdims=True)
    return out, total


def loss_and_gradient(w: dict[str, np.ndarray], inputs: np.ndarray, base: tuple[np.ndarray, np.ndarray], targets: np.ndarray, told: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the told positions of windows (n, WINDOW) of units, and its gradient. Positions of second halves have targets, told (n, HALF)
    and base, which the attention adds to: of the groups (n * HALF, GROUPS) and of the target's group's members."""
    n, weight = len(inputs), told.reshape(-1, 1) / w["p"].dtype.type(max(1, int(told.sum())))
    wide = np.concatenate((w["q"] * _SCALE, w["k"], w["v"]), axis=1)
    x = np.take(w["e"], inputs, axis=0)
    placed = (x + w["p"]).reshape(-1, WIDTH)
    qkv = (placed @ wide).reshape(n, WINDOW, 3 * WIDTH)
    q, k, v = qkv[:, HALF:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    s = np.matmul(q, k.transpose(0, 2, 1))
    s += _MASK
    a, total = _exp(s)
    a /= total
    c = np.matmul(a, v)
    h = (x[:, HALF:] + c).reshape(-1, WIDTH)
    rows, group, member = np.arange(len(h)), targets.ravel() // MEMBERS, targets.ravel() % MEMBERS

    def told_by(logits: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        p, total = _exp(logits)
        loss = -float(np.log(p[rows, t] / total[:, 0] + 1e-30) @ weight[:, 0])
        p *= weight / total
        p[rows, t] -= weight[:, 0]
        return loss, p

    g = {}
    loss, p = told_by(h @ w["group"] + base[0], group, weight)
    g["group"], dh = h.T @ p, p @ w["group"].T
    # positions of one group have one softmax over its members
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
    parts = [(k_, slice(i, j)) for k_, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
    sorted_h, logits = np.take(h, order, axis=0), np.take(base[1], order, axis=0)
    for k_, at in parts:
        logits[at] += sorted_h[at] @ w["member"][k_]
    more, p = told_by(logits, member[order], weight[order])
    g["member"], back = np.zeros_like(w["member"]), np.empty_like(sorted_h)
    for k_, at in parts:
        g["member"][k_], back[at] = sorted_h[at].T @ p[at], p[at] @ w["member"][k_].T
    place = np.empty_like(order)
    place[order] = rows
    dh += np.take(back, place, axis=0)
    dh = dh.reshape(n, HALF, WIDTH)
    ds = np.matmul(dh, v.transpose(0, 2, 1))
    ds -= np.einsum("nid,nid->ni", dh, c)[:, :, None]
    ds *= a
    d = np.empty_like(qkv)
    d[:, :HALF, :WIDTH] = 0
    np.matmul(ds, k, out=d[:, HALF:, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dh, out=d[:, :, 2 * WIDTH :])
    d = d.reshape(-1, 3 * WIDTH)
    dwide = placed.T @ d
    g["q"], g["k"], g["v"] = dwide[:, :WIDTH] * _SCALE, dwide[:, WIDTH : 2 * WIDTH], dwide[:, 2 * WIDTH :]
    dx = (d @ wide.T).reshape(n, WINDOW, WIDTH)
    g["p"] = dx.sum(axis=0)
    dx[:, HALF:] += dh
    flat, g["e"] = inputs.ravel().astype(np.uint16), np.zeros_like(w["e"])
    order = np.argsort(flat, kind="stable")
    seen = flat[order]
    begin = np.flatnonzero(np.diff(seen, prepend=seen[:1] + 1))
    g["e"][seen[begin]] = np.add.reduceat(np.take(dx.reshape(-1, WIDTH), order, axis=0), begin, axis=0)
    return loss + more, g


@dataclass
class Layout:
    """Texts in blocks of HALF positions, each text after a block of ends: units of the ids before, and for each id where it stands."""

    before: np.ndarray
    at: np.ndarray
    first: np.ndarray

    def block_starts(self) -> np.ndarray:
        """Blocks in which ids stand."""
        return np.flatnonzero(np.bincount(self.at // HALF, minlength=len(self.before) // HALF))


def lay_out(ids: np.ndarray, lengths: np.ndarray, unit: np.ndarray) -> Layout:
    """ids of texts of these lengths, one after the other, none empty."""
    blocks = 1 + -(-lengths // HALF)
    begin = np.cumsum(lengths) - lengths
    at = np.repeat(HALF * (np.cumsum(blocks) - blocks + 1) - begin, lengths) + np.arange(len(ids))
    before = np.full(HALF * int(blocks.sum()), unit[END], np.int32)
    units = unit[ids]
    later = np.ones(len(ids), bool)
    later[begin] = False
    before[at[later]] = units[np.flatnonzero(later) - 1]
    return Layout(before, at, begin)


def scoring_tables(w: dict[str, np.ndarray], classes: Classes) -> dict[str, np.ndarray]:
    """What scoring looks up for a unit: query, key and value in one row, and what it says of groups and of members by itself."""
    e, p = w["e"], w["p"]
    qkv = np.concatenate((e @ w["q"] * _SCALE, e @ w["k"], e @ w["v"]), axis=1).astype(np.float32)
    group = e @ w["group"] + classes.group[classes.klass]
    member = np.einsum("ud,gdm->ugm", e, w["member"]) + classes.member[classes.klass]
    return {
        "qkv": qkv, "qp": p[HALF:] @ w["q"] * _SCALE, "kp": np.ascontiguousarray((p @ w["k"]).T), "vp": p @ w["v"],
        "group": w["group"], "own_group": group.astype(np.float32), "member": w["member"], "own_member": member.reshape(-1, MEMBERS).astype(np.float32),
    }


def _log_shares(logits: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log softmax at the targets."""
    p, total = _exp(logits)
    return np.log(np.maximum(p[np.arange(len(p)), targets], np.float32(1e-37)) / total[:, 0])


def id_scores(tables: dict[str, np.ndarray], ids: np.ndarray, layout: Layout, classes: Classes, block: int = 128) -> np.ndarray:
    """Natural log probability of every id."""
    before, target = layout.before, np.zeros(len(layout.before), np.int32)
    target[layout.at] = classes.klass[classes.unit[ids]]
    group, member = target // MEMBERS, target % MEMBERS
    out = np.zeros(len(target), np.float32)
    view, steps = np.lib.stride_tricks.as_strided, (HALF * WIDTH * 4, WIDTH * 4, 4)
    for segment in range(1, len(target) // HALF, SEGMENT):
        stop = min(segment + SEGMENT, len(target) // HALF)
        start, said = segment * HALF, np.empty(((stop - segment) * HALF, WIDTH), np.float32)
        for b in range(segment, stop, block):
            n = min(block, stop - b)
            here = slice(b * HALF, (b + n) * HALF)
            got = np.take(tables["qkv"], before[(b - 1) * HALF : (b + n) * HALF], axis=0)
            q = got[HALF:, :WIDTH].reshape(n, HALF, WIDTH) + tables["qp"]
            k, v = (view(np.ascontiguousarray(got[:, i * WIDTH : (i + 1) * WIDTH]), (n, WINDOW, WIDTH), steps) for i in (1, 2))
            s = np.matmul(q, k.transpose(0, 2, 1))
            s += np.dot(q.reshape(-1, WIDTH), tables["kp"]).reshape(n, HALF, WINDOW)
            s += _MASK
            a, total = _exp(s)
            c = np.matmul(a, v)
            c += np.dot(a.reshape(-1, WINDOW), tables["vp"]).reshape(n, HALF, WIDTH)
            c /= total
            c = said[here.start - start : here.stop - start] = c.reshape(-1, WIDTH)
            logits = np.dot(c, tables["group"])
            logits += np.take(tables["own_group"], before[here], axis=0)
            out[here] = _log_shares(logits, group[here])
        # positions of one group have one softmax over its members
        at = layout.at[slice(*np.searchsorted(layout.at, (start, stop * HALF)))]
        at = at[np.argsort(group[at].astype(np.uint8), kind="stable")]
        ends = np.searchsorted(group[at], np.arange(GROUPS + 1))
        for g, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            here = at[i:j]
            logits = np.dot(np.take(said, here - start, axis=0), tables["member"][g])
            logits += np.take(tables["own_member"], before[here].astype(np.int64) * GROUPS + g, axis=0)
            out[here] += _log_shares(logits, member[here])
    return out[layout.at] + classes.units[classes.klass[before[layout.at]], classes.unit[ids]] + classes.share[ids]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c): counts of all words of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                count.update(text.lower().split())
                if len(count) > COUNTED:
                    yield told()
                    count.clear()
        if count:
            yield told()

    return docs.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(cells: DataFrame, size: int) -> np.ndarray:
    """cells(id, n), as numbers by id: `size` of them at most, whatever the input."""
    out = np.zeros(size)
    got = cells.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def _cells(n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at].astype(np.float64))], names=["id", "n"])


def spelled(counts: DataFrame) -> DataFrame:
    """counts(word, c) with ids, 32-bit binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lexicon().encode
        for b in batches:
            found, size = ids_of_words(b.column(0).to_pylist(), encode)
            ids = [x.tobytes() for x in np.split(found, np.cumsum(size)[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["word", "c", "ids"])

    return counts.mapInArrow(run, "word binary, c bigint, ids binary")


def _spelling(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of spelled words, numbers of ids and counts; (c, ids) are the columns."""
    ids = b.column(1).to_pylist()
    return np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, b.column(0).to_numpy()


def id_counts(words: DataFrame) -> np.ndarray:
    """Counts of ids, from spelled words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(IDS)
        for b in batches:
            ids, size, times = _spelling(b)
            n += np.bincount(ids, np.repeat(times, size), IDS)
        yield _cells(n)

    return _summed(words.select("c", "ids").mapInArrow(run, "id bigint, n double"), IDS)


def inner_counts(words: DataFrame, unit: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From spelled words: units that begin words, classes that end them, and units after classes inside them."""
    u = len(klass)
    size = (1 + CLASSES) * u + CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size)
        for b in batches:
            ids, lengths, times = _spelling(b)
            units = unit[ids].astype(np.int64)
            last = np.cumsum(lengths) - 1
            inside = np.ones(len(ids), bool)
            inside[last] = False
            inside = np.flatnonzero(inside)
            at = [units[last - lengths + 1], (1 + klass[units[inside]].astype(np.int64)) * u + units[inside + 1], (1 + CLASSES) * u + klass[units[last]].astype(np.int64)]
            n += np.bincount(np.concatenate(at), np.concatenate((times, np.repeat(times, lengths)[inside], times)), size)
        yield _cells(n)

    out = _summed(words.select("c", "ids").mapInArrow(run, "id bigint, n double"), size)
    return out[:u], out[(1 + CLASSES) * u :], out[u : (1 + CLASSES) * u].reshape(CLASSES, u)


def _texts(words: list[bytes], many: np.ndarray, known: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the words of texts, of which each has so many: ids with an end after each text, ids of each text, where tokens (words and ends)
    begin, tokens of each text, and counts of the words."""
    tokens = many + 1
    ids, size, count = known(words)
    ends = np.cumsum(tokens) - 1
    sizes = np.ones(int(tokens.sum()), np.int64)
    word = np.ones(len(sizes), bool)
    word[ends] = False
    sizes[word] = size
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), END, np.int32)
    put = np.ones(len(out), bool)
    put[starts[ends]] = False
    out[put] = ids
    return out, np.add.reduceat(sizes, ends - tokens + 1), starts, tokens, count


def light(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of some BYTES of text, one row at least."""
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column(column)).to_numpy()), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts, and how many each has."""
    words = [t.lower().split() for t in texts]
    return list(chain.from_iterable(words)), np.fromiter(map(len, words), np.int64, len(words))


def encoded(docs: DataFrame) -> DataFrame:
    """docs(..., text) with ids in place of texts: 16-bit binary, an end after each text."""
    others = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon()
        for b in light(batches, len(others)):
            ids, lengths, *_ = _texts(*_split(b.column(len(others)).to_pylist()), known)
            offsets = np.concatenate(([0], 2 * np.cumsum(lengths))).astype(np.int32)
            told = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], told], names=[*others, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("ids", BinaryType())]))


def _read_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of encoded texts, one after the other, and how many each has."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16), pc.binary_length(column).to_numpy().astype(np.int64) // 2


def windows_of(texts: list[bytes], unit: np.ndarray, known: Lexicon) -> np.ndarray:
    """Windows of texts: WINDOW units before, then the second half's own units, -1 beyond the text."""
    return windows_of_ids(*_texts(*_split(texts), known)[:2], unit)


def windows_of_ids(ids: np.ndarray, lengths: np.ndarray, unit: np.ndarray) -> np.ndarray:
    layout = lay_out(ids, lengths, unit)
    own = np.full(len(layout.before), -1, np.int16)
    own[layout.at] = unit[ids]
    before, blocks = layout.before.astype(np.int16).reshape(-1, HALF), layout.block_starts()
    return np.concatenate((before[blocks - 1], before[blocks], own.reshape(-1, HALF)[blocks]), axis=1)


def across_counts(docs: DataFrame, unit: np.ndarray, klass: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each unit that begins a word or is the end comes after each class in docs(text), or in docs(ids) as encoded. starts: whether a unit does."""
    u = len(klass)
    docs = docs if docs.columns == ["ids"] else encoded(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES * u)
        for b in light(batches, 0):
            ids, lengths = _read_ids(b.column(0))
            own = unit[ids]
            before = np.concatenate(([unit[END]], own[:-1]))
            before[np.cumsum(lengths) - lengths] = unit[END]
            real = starts[own]
            n += np.bincount(klass[before[real]].astype(np.int64) * u + own[real], minlength=len(n))
        yield _cells(n)

    return _summed(docs.mapInArrow(run, "id bigint, n double"), CLASSES * u).reshape(CLASSES, u)


def train_pass(w: dict[str, np.ndarray], windows: np.ndarray, classes: Classes, seed: int, rate: float = RATE) -> tuple[dict[str, np.ndarray], float]:
    """One pass of Adam over windows (of windows_of); the weights and the mean loss."""
    order = np.random.default_rng(seed).permutation(len(windows))
    flat = np.frombuffer(bytearray(_packed(w)), np.float32)
    w = _unpacked(flat, w)
    m, s, step_by = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    losses, size = [], min(MOST, max(BATCH, len(order) // STEPS))
    for step, i in enumerate(range(0, len(order), size), 1):
        got = windows[order[i : i + size]]
        inputs, own = got[:, :WINDOW], got[:, WINDOW:]
        last, targets = classes.klass[inputs[:, HALF:].ravel()], classes.klass[np.maximum(own, 0)]
        base = np.take(classes.group, last, axis=0), np.take(classes.member.reshape(-1, MEMBERS), last * GROUPS + targets.ravel() // MEMBERS, axis=0)
        loss, g = loss_and_gradient(w, inputs, base, targets, own >= 0)
        losses.append(loss)
        g = np.concatenate([g[k].ravel() for k in sorted(g)])
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        np.sqrt(s, out=step_by)
        step_by *= np.float32(1 / math.sqrt(1 - 0.99**step))
        step_by += np.float32(1e-8)
        np.divide(m, step_by, out=step_by)
        flat -= np.float32(rate / (1 - 0.9**step)) * step_by
    return w, float(np.mean(losses))


def _packed(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def _unpacked(data: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = data[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train(docs: DataFrame, unit: np.ndarray, classes: Classes, total: float) -> dict[str, np.ndarray]:
    """Weights after ROUNDS averaged rounds over docs(id, ids) of `total` ids, each document in one of them. Weights of n tasks meet in the square
    root of n sums, which the driver gets."""
    w = start_weights()
    parts = max(1, math.ceil(total / (HALF * PART * ROUNDS)))
    teams = math.isqrt(parts) + 1
    kind = "team long, n long, weights binary"

    def mean(rows: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
        n, out = 0, None
        for k, data in rows:
            got = np.frombuffer(data, np.float32) * np.float32(k)
            n, out = n + k, got if out is None else out + got
        return n, out / np.float32(max(1, n))

    def one(part: int, n: int, weights: bytes) -> pa.Table:
        return pa.table({"team": pa.array([part % teams], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([weights], pa.binary())})

    def passes(w: dict[str, np.ndarray], turn: int):
        def run(key, rows):
            told = rows.select(["id", "ids"]).sort_by([("id", "ascending"), ("ids", "ascending")])
            windows = np.concatenate([windows_of_ids(*_read_ids(b.column(1)), unit) for b in light(told.to_batches())])
            new, _ = train_pass(w, windows, classes, seed=turn * parts + key[0].as_py(), rate=RATE / (1 + turn))
            return one(key[0].as_py(), len(windows), _packed(new))

        return run

    def met(key, rows):
        n, data = mean(list(zip(rows["n"].to_pylist(), rows["weights"].to_pylist(), strict=True)))
        return one(key[0].as_py(), n, data.astype(np.float32).tobytes())

    deal = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(ROUNDS * parts))
    dealt = docs.select("id", "ids", (deal % ROUNDS).alias("turn"), F.floor(deal / ROUNDS).alias("part"))
    for turn in range(ROUNDS):
        got = dealt.filter(F.col("turn") == turn).select("part", "id", "ids").groupBy("part").applyInArrow(passes(w, turn), kind).groupBy("team").applyInArrow(met, kind).collect()
        if got:
            w = _unpacked(mean([(r.n, r.weights) for r in sorted(got, key=lambda r: r.team)])[1], w)
    return w


@dataclass
class Model:
    """counts(word, c) is a table; all else is bounded."""

    counts: DataFrame
    total: int
    distinct: int
    ends: int
    classes: Classes
    weights: dict[str, np.ndarray]
    frequent: dict[bytes, int]

    @property
    def mixture(self) -> float:
        """Mean weight of the attention model's probability beside the word's share."""
        return sum(MIXTURES) / len(MIXTURES)


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """usable: which rows to learn from."""
    taught = docs.filter(usable).select(F.col(id_col).cast("string").alias("id"), raw(text_col).alias("text"))
    words = stored(spelled(word_counts(taught.select("text"))), "op7-words")
    counts = words.select("word", "c")
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = taught.count()
    ids = id_counts(words)
    ids[END] += ends
    unit, share, klass = groups(ids)
    first, last, inside = inner_counts(words, unit, klass)
    first[unit[END]] += ends
    last[klass[unit[END]]] += ends

    starts = np.zeros(len(klass), bool)
    starts[np.unique(unit[np.flatnonzero(begins_word())])] = True
    told = stored(encoded(taught), "op7-ids")
    classes = Classes(ids, first, last, inside, across_counts(told.select("ids"), unit, klass, starts), (unit, share, klass))
    weights = train(told, unit, classes, ids.sum())
    drop_stored(told)

    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    frequent = dict(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True))
    return Model(counts, seen.n + ends, seen.v + (ends > 0), ends, classes, weights, frequent)


def begins_word() -> np.ndarray:
    """Which ids begin with a space, or are the end."""
    decode = word_ids(VOCABULARY).bytes_of
    return np.array([k == END or decode(k)[:1] == b" " for k in range(IDS)])


def _word_scores(tables: dict[str, np.ndarray], classes: Classes, words: list[bytes], many: np.ndarray, known: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log probability of each token by the attention model, tokens of each text, and counts of the words. Five decimals: the last
    digits of products depend on what else is in the batch."""
    ids, lengths, starts, tokens, count = _texts(words, many, known)
    scores = id_scores(tables, ids, lay_out(ids, lengths, classes.unit), classes).astype(np.float64)
    return np.round(np.add.reduceat(scores, starts), 5), tokens, count


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    word_kind = pa.struct([("word", pa.binary()), ("s", pa.float64())])
    weights, classes, frequent, ends = model.weights, model.classes, model.frequent, model.ends
    total = max(1, model.total)
    room = math.log10(model.total + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = lexicon(frequent), scoring_tables(weights, classes)
        row = TaskContext.get().partitionId() << 40
        for b in light(batches):
            words, many = _split(b.column(1).to_pylist())
            s, tokens, count = _word_scores(tables, classes, words, many, known)
            c, word = np.full(len(s), float(ends)), np.ones(len(s), bool)
            last = np.cumsum(tokens) - 1
            word[last] = False
            c[word] = count
            far = np.isnan(c)
            begin = last - tokens + 1
            near = np.where(far, 0.0, c)
            with np.errstate(divide="ignore"):
                share = np.log(near / total)
            high = np.maximum(s, share)
            told, held = np.exp(s - high), np.exp(share - high)
            mixed = [(high + np.log(m * told + (1 - m) * held)) / math.log(10) for m in MIXTURES]
            sums = [np.add.reduceat(np.where(far, 0.0, x), begin) for x in (c > 0, np.log10(near + 1), *mixed)]
            tail = pa.StructArray.from_arrays([pa.array([words[i] for i in np.flatnonzero(np.isnan(count)).tolist()], pa.binary()), pa.array(s[far])], fields=list(word_kind))
            offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(far, begin, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(many))), b.column(0), pa.array(tokens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), *map(pa.array, sums[2:]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)],
                names=["row", id_col, "n_tokens", "near_known", "near_base", *(f"near{k}" for k in range(len(MIXTURES))), "tail"],
            )
            row += len(many)

    schema = f"row bigint, `{id_col}` {kind}, n_tokens bigint, near_known bigint, near_base double, {', '.join(f'near{k} double' for k in range(len(MIXTURES)))}, tail array<struct<word:binary,s:double>>"
    scored = stored(docs.select(id_col, raw(text_col)).mapInArrow(run, schema), "op7-scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.s").join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))

    def mixed(m: float) -> Column:
        alone = F.col("s") + math.log(m)
        both = F.log(F.exp(alone) + (1 - m) * F.col("c") / F.lit(float(total)))
        return F.when(F.col("c") > 0, both).otherwise(alone) / math.log(10)

    far = tail.groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("far_known"), F.sum(F.log10(F.col("c") + 1)).alias("far_base"), *(F.sum(mixed(m)).alias(f"far{k}") for k, m in enumerate(MIXTURES))
    )
    out = scored.drop("tail").join(far, "row", "left")
    none = F.lit(0.0)
    each = [F.col(f"near{k}") + F.coalesce(f"far{k}", none) for k in range(len(MIXTURES))]
    best = F.greatest(*each)
    score = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in each), none) / len(MIXTURES))
    return out.select(
        id_col, "n_tokens", (F.col("near_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("near_base") + F.coalesce("far_base", none) - F.col("n_tokens") * F.lit(room)).alias("base_score"), score.alias("score"),
    )


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(docs, crc_mod("doc_id", 7) != 2))
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
