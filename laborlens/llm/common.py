"""Helpers shared by the operators: tables, shared folder, word hashes, Bloom filter, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.session import shared_dir

#: Rows whose text is turned into Python objects at once.
SLICE = 256
#: Interned words per task before the cache starts anew; bounds a worker's memory.
CACHE = 300_000

U64 = np.uint64
_C1, _C2, _C3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def raw(column: str = "text") -> Column:
    """UTF-8 bytes, null as empty: what Arrow then hands to Python unchecked and uncopied."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b"")).alias(column)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what lies at path, in whichever store that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        drop_path(df.sparkSession, f.rsplit("/", 1)[0])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> U64(30))) * _C1
    x = (x ^ (x >> U64(27))) * _C2
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash, interned. Call with a text's bytes to get the hashes of its words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; fewer words give one hash of the whole sequence; none give none."""
    n = len(hashes)
    if not n:
        return hashes
    size, short = min(size, n), n < size
    with np.errstate(over="ignore"):
        out = hashes[: n - size + 1].copy()
        for k in range(1, size):
            out = mix(out * _C3 + hashes[k : n - size + 1 + k])
        return mix(out + U64(size)) if short or size == 1 else out


def growing(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """shingles() of each of the ascending sizes above 1, of which there are any; each goes on from the one before."""
    out, n = hashes, len(hashes)
    with np.errstate(over="ignore"):
        for size in range(2, min(n, max(sizes, default=0)) + 1):
            out = mix(out[: n - size + 1] * _C3 + hashes[size - 1 :])
            if size in sizes:
                yield size, out


def min_max(values: np.ndarray, mult: np.ndarray, add: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Min and max of mult*x+add over all x, for each (mult, add): two signature values per hash evaluation."""
    low = np.full(len(mult), np.iinfo(U64).max, U64)
    high = np.zeros(len(mult), U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(values), block):
            h = values[None, i : i + block] * mult[:, None] + add[:, None]
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
    return low, high


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=U64)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` consecutive values; the band's number is part of it."""
    bands = signature.reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, len(bands) + 1, dtype=U64) * _C3)
        for k in range(rows):
            key = mix(key * _C3 + bands[:, k])
    return key


#: Bits of a Bloom filter: 16 for each key, a power of two between these. With the most, 32 MB, some 40 million keys pass one in ten others.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bloom_spots(words: np.ndarray, column: str | Column) -> list[Column]:
    """Where a key's two bits are in the filter. Ids are hashed; a column of hashes can use hash_spots()."""
    h, bits = F.xxhash64(column), F.lit(64 * len(words))
    return [F.pmod(h, bits).alias("spot1"), F.pmod(F.shiftrightunsigned(h, 30), bits).alias("spot2")]


def hash_spots(words: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """The same for 64-bit hashes, in numpy."""
    bits = U64(64 * len(words))
    return [(hashes % bits).astype(np.int64), ((hashes >> U64(30)) % bits).astype(np.int64)]


def bloom(keys: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """Bloom filter of a long column (hashed: of 64-bit hashes), built by Spark; the driver gets MOST_BITS / 64 words at
    most, whatever the input.

    It only spares work: whoever uses it joins exactly afterwards. With very many keys it lets more and more others pass.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    h = F.col(column) if hashed else F.xxhash64(column)
    spots = keys.select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 30), F.lit(bits)))).alias("spot"))
    words = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(U64)


def in_bloom(words: np.ndarray, spots: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(len(spots[0]), bool)
    for s in spots:
        ok &= (words[s >> 6] >> (s & 63).astype(U64)) & U64(1) == U64(1)
    return ok


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one edge down, to an id that has none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(False).alias("hub")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(True).alias("hub")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.bool_or("hub").alias("hub")).filter("down > 1 or (down = 1 and hub)").isEmpty()


def components(edges: DataFrame, what: str = "cc") -> DataFrame:
    """(id, component) for every id in edges(a, b): the smallest id reachable.

    Alternates large-star and small-star steps (minimum of a neighbourhood by partial aggregation, then an equi-join
    that AQE can split), each written to the shared folder, until the edges are stars. Rounds grow with the logarithm
    of the number of ids. Edges with a null end and loops are ignored.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        mid = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), what)
        low = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), what)
        drop_stored(now)
        drop_stored(mid)
        now = new
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
