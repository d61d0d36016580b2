"""MinHash near-duplicates with min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of a document's shingles, so PERMUTATIONS
evaluations make twice as many values. Bands of ROWS values are keys; documents that share a key are candidates, and a
link is made only after the full shingle sets have been compared.

No group is expanded into pairs. Documents of one set are one class, known by its smallest id. Then, round by round, every
class is compared with one other per round: of the classes it shares a key with, the one that shares the most keys
with most classes, if it is not yet in its component; linked classes are put in one component and need no comparison among
themselves. After ROUNDS rounds, classes that still share a key across components are compared by their rarest elements, of
which similar sets must share one (_sharing_rare), so no candidate is dropped and no group of a key is paired. Sets are made
again only for classes that share a key with another (a Bloom filter over their ids spares the others; the joins after it
are exact).

With BANDS bands of ROWS rows a pair of similarity 0.8 shares a key with probability 1-(1-0.8^6)^30 = 0.9999, one of 0.3
with 0.02.

Cases: null and empty texts have no set, are linked with nothing and stay; null ids can't be named: they are kept with a
null component and linked with nothing; rows that repeat an id are one document, linked through the id, whatever their
texts, but for rows without words, which stay by themselves; an empty table gives no row; further columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import WordHashes, band_keys, bloom, bloom_spots, components, drop_stored, in_bloom, min_max, permutations, raw, shingles, slices, stored, table

ROWS = 6
BANDS = 30
PERMUTATIONS = ROWS * BANDS // 2
ROUNDS = 3
SEED = 8


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_hash of 16 bytes, keys: one per band) for each row; texts without words have null hash and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        mult, add = permutations(PERMUTATIONS, SEED)
        for b in slices(batches):
            n, hashes, keys = [], [], []
            for text in b.column(1).to_pylist():
                got = np.unique(shingles(words(text.lower().split()), size))
                n.append(len(got))
                hashes.append(hashlib.blake2b(got.tobytes(), digest_size=16).digest() if len(got) else None)
                keys.append(band_keys(np.stack(min_max(got, mult, add), axis=1).ravel(), ROWS).view(np.int64) if len(got) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_hash", "keys"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), raw(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_shingles bigint, set_hash binary, keys array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, words: the distinct shingle hashes) of at least the given ids."""
    filter_ = bloom(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in slices(batches):
            keep = in_bloom(filter_, [b.column(k).to_numpy() for k in (2, 3)])
            texts = b.column(1).filter(pa.array(keep)).to_pylist()
            sets = [np.unique(shingles(words(t.lower().split()), size)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "words"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), raw(text_col).alias("text"))
    return rows.select("id", "text", *bloom_spots(filter_, "id")).mapInArrow(run, "id bigint, words array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which the sets are similar enough; ids with several sets are linked by any of them."""
    left = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.filter(100 * common >= percent * (F.size("wa") + F.size("wb") - common)).select("a", "b").distinct()


def link_rounds(live: DataFrame, sets: DataFrame, links: DataFrame, percent: int, what: str) -> DataFrame:
    """(id, component) of all ids that are linked with another.

    live(rep, n, key): classes, sizes of their sets and the keys they share with others; sets(id, words); links(a, b):
    what is linked already.
    """
    tested, scratch = None, []
    # who shares many keys with many is likely to be what the others were copied from
    often = live.groupBy("key").agg(F.count("*").alias("often"))
    pull = live.join(often, "key").groupBy("rep").agg(F.sum("often").alias("pull"))
    live = stored(live.join(pull, "rep"), f"{what}-pull")
    near = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    label = stored(components(links), f"{what}-cc")

    def compared(found: DataFrame, label: DataFrame) -> DataFrame:
        new = stored(_linked(found, sets, percent), f"{what}-links")
        if new.isEmpty():
            return label
        merged = stored(_merged(label, new, what), f"{what}-cc")
        drop_stored(label)
        drop_stored(new)
        return merged

    def grouped() -> DataFrame:
        return live.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    for _ in range(ROUNDS):
        now = grouped()
        hubs = now.groupBy("key").agg(F.max(F.struct("pull", "rep", "n", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        found = now.join(hubs, "key").filter(F.col("component") != F.col("hub.component"))
        found = found.select(F.col("rep").alias("a"), "n", F.col("hub.rep").alias("b"), F.col("hub.n").alias("m"), F.col("hub.pull").alias("pull")).filter(near).distinct()
        if tested is not None:
            again = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            found = found.join(again, ["a", "b"], "left_anti")
        found = found.groupBy("a").agg(F.max_by("b", F.struct("pull", "b")).alias("b"))
        found = stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{what}-pairs")
        if found.isEmpty():
            break
        tested = found if tested is None else tested.unionByName(found)
        scratch.append(found)
        label = compared(found, label)

    now = grouped()
    open_ = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    left = now.join(open_, "key").groupBy("rep").agg(F.first("component").alias("component"))
    scratch += [live, stored(left, f"{what}-open")]
    found = _sharing_rare(scratch[-1], sets, percent, what, scratch)
    found = stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{what}-pairs")
    label = compared(found, label)
    for done in [*scratch, found]:
        drop_stored(done)
    return label


def _low(size: str) -> str:
    """SQL for the least size of a size's bucket: 32 steps up to each power of two, so that sizes of a bucket differ by 3 %."""
    return f"shiftleft(shiftright({size}, {_step(size)}), {_step(size)})"


def _step(size: str) -> str:
    return f"greatest(length(bin({size})) - 6, 0)"


def _sharing_rare(left: DataFrame, sets: DataFrame, percent: int, what: str, scratch: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of classes left(rep, component) of different components that may be similar enough; none of those is left out.

    Sets of n and m elements of the similarity share s = ceil(percent * (n + m) / (100 + percent)) of them. With all elements in one
    order, rarest first, they share one of the first n - s + 1 of the one and m - s + 1 of the other. What is first depends on the
    partner's size, so each class asks for each bucket of sizes within its reach. A class that is too far from the hub of its group
    has so many elements of its own that none of the group's common ones comes first: it meets nobody. What it stores goes to scratch.
    """
    held = left.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "component", F.xxhash64("words").alias("which"), F.size("words").cast("bigint").alias("n"), "words")
    # stored, or Spark would hash the whole set once for each element
    scratch.append(stored(held, f"{what}-left"))
    elements = scratch[-1].select("rep", "component", "which", "n", F.explode("words").alias("w"))
    often = elements.groupBy("w").agg(F.count("*").alias("often")).filter("often > 1")
    common = elements.join(often, "w").groupBy("rep", "component", "which", "n").agg(F.sort_array(F.collect_list(F.struct("often", "w"))).alias("e"))
    reach = common.withColumn("least", F.expr(f"({percent} * n + 99) div 100")).withColumn("most", F.expr(f"100 * n div {percent}"))
    buckets = F.expr(f"array_distinct(transform(sequence({_low('least')}, most, shiftleft(1L, {_step('least')})), m -> {_low('m')}))")
    asks = reach.withColumn("own", F.expr(_low("n"))).withColumn("other", F.explode(buckets))
    # how many elements come first, less those that nobody else has
    first = F.expr(f"cast(size(e) + 1 - ({percent} * (n + greatest(other, least)) + {99 + percent}) div {100 + percent} as int)")
    heads = asks.withColumn("first", first).filter("first > 0").withColumn("k", F.size("e"))
    heads = heads.select("rep", "component", "n", "own", "other", "k", F.posexplode(F.slice("e", F.lit(1), F.col("first"))).alias("at", "of"))
    # rest: elements from this one on
    heads = stored(heads.select("rep", "component", "n", "own", "other", F.col("of.w").alias("w"), (F.col("k") - F.col("at")).alias("rest")), f"{what}-heads")
    scratch.append(heads)
    far = heads.select("w", F.col("own").alias("other"), F.col("other").alias("own"), F.col("rep").alias("b"), F.col("component").alias("far"), F.col("n").alias("m"), F.col("rest").alias("left"))
    both = heads.withColumnRenamed("rep", "a").join(far, ["w", "own", "other"])
    return both.filter(f"component < far and {100 + percent} * least(rest, left) >= {percent} * (n + m)").select("a", "b")


def _merged(label: DataFrame, links: DataFrame, what: str) -> DataFrame:
    """label(id, component) after further links. Only the components that these touch are worked on."""

    def root(end: str) -> DataFrame:
        return label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))

    edges = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    moved = stored(components(edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), what), f"{what}-moved")
    again = label.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = moved.join(label.select("id"), "id", "left_anti")
    return again.select("id", F.coalesce("to", "component").alias("component")).unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for each row: component is the smallest id reachable over links of similarity of at
    least `percent`. `size` words make a shingle."""
    sig = stored(signatures(docs, size, id_col, text_col), "op8-sig")
    known = sig.filter("id is not null and set_hash is not null")
    # equal sets have equal keys; a large group is one row of each task before it is dealt
    classes = stored(known.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "op8-classes")
    reps = classes.select("set_hash", "rep")

    # one row for each class and key that another class has too
    keys = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    live = stored(keys.join(shared, "key").distinct(), "op8-live")
    sets = stored(_sets(docs, live.select(F.col("rep").alias("id")).distinct(), size, id_col, text_col), "op8-sets")

    # an id with several texts links their classes
    several = known.groupBy("id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).filter("low <> high").select("id")
    several = known.select("id", "set_hash").join(several, "id").join(reps, "set_hash")
    named = several.select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a <> b")

    label = link_rounds(live, sets, named, percent, "op8")
    drop_stored(sets)
    drop_stored(live)
    # stored, so that the join of the rows is one by itself and Spark can split a large group
    told = stored(reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component")), "op8-told")
    of_row = sig.select("id", "n_shingles", "set_hash").join(told, "set_hash", "left")
    return of_row.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows whose id is not the smallest of its component; rows that repeat a kept id all stay."""
    found = near_duplicates(docs, size, percent, id_col, text_col)
    gone = found.filter(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti").select(*docs.columns)


def op8_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
