"""Document fingerprints by locally consistent parsing.

Bytes are the first names. At each level, runs of one name become one name; deterministic coin tossing (position of the
lowest bit in which a name differs from the one before it, and that bit) is applied until labels are below eight; local
maxima of the labels begin phrases; a phrase's name is a hash of the names in it. A label depends on a few names to its
left only, so equal substrings get equal names inside, wherever they begin. A text's set holds the names of the phrases
from level FIRST_LEVEL (some 27 bytes) up to the name of the whole; the fingerprint is the SIZE smallest 32-bit hashes
of the set, in hex; the likeness of two fingerprints is the bottom-SIZE estimate of the sets' Jaccard similarity,
exact where both sets are smaller.

Next documents: ids are dealt into ranges by approximate quantiles; each range is sorted inside a task; the first row of
a range is sent to the range before it as a guest. Only range bounds and heads (a few per shuffle partition) pass the
driver. Texts are compressed before the shuffle.

Cases: null and empty texts have the empty fingerprint and are alike by 1 among themselves and 0 to others; rows of one
id follow by a hash of their texts, repeated rows one another; null ids come last; a lone row is its own next; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import U64, mix, raw, slices, table

SIZE = 64
FIRST_LEVEL = 3
#: Bytes of texts parsed in one array.
BLOCK = 1 << 18
#: Ranges per shuffle partition.
RANGES = 4

_STEP = U64(0x9E3779B97F4A7C15)
#: Phrases of bytes are shorter than this: labels below eight rise at most seven times and fall as often.
PLACES = 32
with np.errstate(over="ignore"):
    _PLACED = mix(np.arange(1, 1 + PLACES * 256, dtype=U64) * _STEP)


def _coin(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of names of which neighbours differ: 2 * lowest differing bit + that bit. A text's first name has no
    neighbour and shows its lowest bit."""
    one = x.dtype.type(1)
    differ = x[1:] ^ x[:-1]
    low = differ & (~differ + one)
    out = np.empty(len(x), np.uint8)
    out[1:] = np.bitwise_count(low - one) * np.uint8(2) + ((x[1:] & low) != 0)
    out[first] = x[first] & one
    return out


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level. first: where texts begin; several lie in one array, so that numpy has long rows."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    starts = np.flatnonzero(new)
    long = ()
    if len(starts) < len(x):
        runs = np.diff(starts, append=len(x))
        first = np.searchsorted(starts, first)
        x = x[starts]
        long = np.flatnonzero(runs > 1)
    # 256 labels become 16, then 8; 2**64 become 128, 14, 8
    label = x
    for _ in range(2 if x.dtype == np.uint8 else 3):
        label = _coin(label, first)
    peak = np.zeros(len(x), bool)
    np.greater(label[1:-1], label[:-2], out=peak[1:-1])
    peak[1:-1] &= label[1:-1] >= label[2:]
    peak[np.append(first[1:] - 1, len(x) - 1)] = False
    peak[np.minimum(first + 1, len(x) - 1)] = False
    peak[first] = True
    starts = np.flatnonzero(peak).astype(np.int32)
    lengths = np.diff(starts, append=np.int32(len(x)))
    place = np.arange(len(x), dtype=np.int32) - np.repeat(starts, lengths)
    if x.dtype == np.uint8:
        names = _PLACED[(np.minimum(place, PLACES - 1) << 8) | x]
    else:
        names = mix(x + place.astype(U64) * _STEP)
    if len(long):
        names[long] = mix(names[long] + runs[long].astype(U64) * _STEP)
    return mix(np.add.reduceat(names, starts) + lengths.astype(U64)), np.searchsorted(starts, first)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.flatnonzero(lengths)
    lengths = lengths[owner]
    x = np.frombuffer(b"".join(texts), np.uint8)
    kept, level = [np.zeros(0, U64)], 0
    while len(owner):
        first = np.cumsum(lengths) - lengths
        if level:
            x, first = parse(x, first)
            lengths = np.diff(first, append=len(x))
        over = lengths == 1
        tell = np.ones(len(x), bool) if level >= FIRST_LEVEL else np.repeat(over, lengths)
        kept.append(np.repeat(owner, lengths)[tell].astype(U64) << U64(32) | mix(x[tell].astype(U64) + U64(level)) >> U64(32))
        if over.any():
            x, owner, lengths = x[np.repeat(~over, lengths)], owner[~over], lengths[~over]
        level += 1
    names = np.unique(np.concatenate(kept))
    cuts = np.searchsorted(names, np.arange(len(texts) + 1).astype(U64) << U64(32))
    return [(names[a:b] & U64(0xFFFFFFFF)).astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def phrase_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the distinct 32-bit hashes, ascending, of its phrases from FIRST_LEVEL up to the whole."""
    out, block, held = [], [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            if block and held + len(t) > BLOCK:
                out += _sets(block)
                block, held = [], 0
            block.append(t)
            held += len(t)
        return out + (_sets(block) if block else [])


def fingerprints_of(texts: list[bytes]) -> list[np.ndarray]:
    return [x[:SIZE] for x in phrase_sets(texts)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIZE] if max(len(a), len(b)) >= SIZE else np.union1d(a, b)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def as_hex(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, id, tie, blob) sorted within partitions so that each row's next document follows it: the
    next row of its bucket, of which the last one is a guest from the following bucket. Texts are zstd-compressed."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), raw(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = RANGES * parts
    bounds = np.unique(np.array(docs.select(F.col(id_col).cast("bigint").alias("id")).approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n), np.float64)).astype(np.int64)

    def buckets(ids: pa.Array) -> np.ndarray:
        out = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, out)

    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(buckets(b.column(0)), pa.int32()), b.column(0), b.column(1)], names=["bucket", "id", "tie"])

    heads = rows.select("id", "tie").mapInArrow(dealt, "bucket int, id bigint, tie bigint").groupBy("bucket").agg(F.max(F.struct(F.coalesce("id", F.lit(-(2**63))).alias("o"), "tie")).alias("head"), F.max("id").alias("id"))
    found = sorted(((r.bucket, r.id, r.head.tie) for r in heads.collect()), reverse=True)
    # the head of each bucket goes to the bucket before it, the first one's to the last
    guests = {b: (i, t, found[k - 1][0]) for k, (b, i, t) in enumerate(found)}

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            bucket = buckets(b.column(0)).tolist()
            ids, ties = b.column(0).to_pylist(), b.column(2).to_pylist()
            blobs = list(map(pack, b.column(1).to_pylist()))
            guest = [0] * len(ids)
            for k in range(len(ids)):
                i, t, to = guests[bucket[k]]
                if (ids[k], ties[k]) == (i, t):
                    for col, v in ((bucket, to), (ids, i), (ties, t), (blobs, blobs[k]), (guest, 1)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(guest, pa.int32()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(blobs, pa.binary())],
                names=["bucket", "guest", "id", "tie", "blob"],
            )

    out = rows.mapInArrow(squeeze, "bucket int, guest int, id bigint, tie bigint, blob binary").repartition(parts, "bucket")
    return out.sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), F.col("tie").desc())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text (its last half replaced by the beginning of
    the next document), and the likeness of its own to that and to the next document's."""
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held = None
        for b in slices(batches):
            data = list(map(unpack, b.column(4).to_pylist()))
            rows, edits = [], []
            for bucket, guest, doc, text, own in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), data, fingerprints_of(data), strict=True):
                if guest and (held is None or held[0] != bucket):
                    continue  # a further guest of a bucket that is over
                text = text.decode("utf-8", "surrogateescape")
                if held is not None and held[0] == bucket:
                    _, i, t, f = held
                    half = len(t) // 2
                    edits.append((t[: len(t) - half] + text[:half]).encode("utf-8", "surrogateescape"))
                    rows.append((i, len(t), f, own))
                held = None if guest else (bucket, doc, text, own)
            new = fingerprints_of(edits)
            columns = [[r[0] for r in rows], [r[1] for r in rows], [hashlib.sha256(e).hexdigest() for e in edits], [as_hex(r[2]) for r in rows], list(map(as_hex, new))]
            columns += [[likeness(r[2], e) for r, e in zip(rows, new, strict=True)], [likeness(r[2], r[3]) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_locally_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
