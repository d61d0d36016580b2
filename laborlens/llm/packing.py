"""Cost-balanced packing of token sequences.

A piece of n tokens costs linear*n + quadratic*n*n (attention stays inside a document). Documents are tokenised inside
the tasks and packed group by group, a group being at most GROUP_TOKENS tokens of one partition in row order, so no text
or token is shuffled and no task holds more than one group. Within a group, whole sequences are cut off long documents;
the rests go, longest first, to the sequence of lowest cost that still has room, and where none has room for all of it,
the rest is cut to fill the emptiest ones. A group wastes less than one sequence.

Ids are those of the `tokenizers` library on byte_bpe_50k.json without special tokens; they are drawn from the same
vocabulary through tiktoken, several times faster, and a test holds the two against each other. Text is cut at single
spaces between two non-spaces, which no pre-token of that vocabulary spans, so ids of a word can be kept.

Cases: null and empty texts are the end id alone; null ids stay null; repeated rows are packed each; an empty table
gives no row; further columns are ignored; special tokens' strings in a text are ordinary text, as the vocabulary's own
description has it (encode_special_tokens = True). Which pieces share a sequence follows from how the rows are partitioned.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import slices, table

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 1 << 22
#: Words per generation of the cache; two generations are held.
WORDS = 250_000

_BESIDE_SPACE = re.compile(r" \s|\s ")
_CUTS = re.compile(r"(?<=\S) (?=\S)")


class WordIds(dict):
    """piece -> little-endian 32-bit ids of the piece with a space before it."""

    def __init__(self, vocabulary: str):
        super().__init__()
        path = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.bytes_of = encoding.encode_ordinary, encoding.decode_single_token_bytes
        self.old: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.raw(" " + piece)
            if len(piece) > 64:
                return got
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got

    def __call__(self, text: str) -> bytes:
        pieces = _CUTS.split(text) if _BESIDE_SPACE.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")
        return self.raw(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))


_word_ids: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One cache for all tasks that a worker runs."""
    if vocabulary not in _word_ids:
        _word_ids[vocabulary] = WordIds(vocabulary)
    return _word_ids[vocabulary]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every token lies in one piece."""
    out, rests = [], []
    sequences = 0
    for k, n in enumerate(lengths):
        whole = n // capacity
        out += [(k, i * capacity, capacity, sequences + i, 0) for i in range(whole)]
        sequences += whole
        if n % capacity:
            rests.append((k, whole * capacity, n % capacity))
    room = np.full(-(-sum(r[2] for r in rests) // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    for k, start, n in sorted(rests, key=lambda r: (-r[2], r[0])):
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(room.argmax())
            part = min(n, int(room[at]))
            out.append((k, start, part, sequences + at, capacity - int(room[at])))
            room[at] -= part
            cost[at] += linear * part + quadratic * part * part
            start, n = start + part, n - part
    return out


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json",
    linear: float = 1.0, quadratic: float = 1 / CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids
    as little-endian 32-bit binary."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[bytes] = []
        held, id_type = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            pieces = pack([len(t) // 4 for t in tokens], capacity, linear, quadratic)
            for i in range(0, len(pieces), 8192):
                part = pieces[i : i + 8192]
                cuts = [tokens[k][4 * s : 4 * (s + n)] for k, s, n, *_ in part]
                columns = [pa.array([ids[k] for k, *_ in part], id_type), *(pa.array([p[j] for p in part], pa.int64()) for j in (1, 2))]
                columns += [pa.array(map(zlib.crc32, cuts), pa.int64()), pa.array([len(tokens[k]) // 4 for k, *_ in part], pa.int64())]
                columns += [pa.array([first + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cuts, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
            first += max((p[3] for p in pieces), default=-1) + 1
            ids.clear()
            tokens.clear()
            held = 0

        for b in slices(batches):
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                tokens.append((encode(text) if text else b"") + end)
                held += len(tokens[-1]) // 4
                if held >= GROUP_TOKENS:
                    yield from flush()
        if tokens:
            yield from flush()

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
