"""Token ids in Arrow files of fixed-size lists.

Documents in ascending order of id (nulls first) are tokenised, each followed by END_ID, and strung together; the string is cut into
sequences of `length` ids. A file is an Arrow stream file (the random-access form, with a footer) of these columns:

* ids   fixed_size_list<uint16>[length] (or another `kind`, for vocabularies above 65,536), padded with 0 in a file's last sequence only;
* mask  fixed_size_list<bool>[length], true for an id and false for padding; Arrow keeps it as bits;
* doc_id, doc_start, offset  lists with an entry for each document of the sequence: its id, its ids before this sequence, where it begins here.

Every batch but a file's last holds BATCH sequences, and both list columns have one flat buffer of equal steps, so sequence k of a file is
batch k // BATCH, row k % BATCH, as a view of the mapped file. The schema's metadata hold the file's shard and part, by which files are ordered.

Rows are dealt out by ranges of (id, hash of the text, a random number that splits repeats) and sorted inside; a shard is one range and
writes a file whenever FILE_TOKENS ids are together, so no document is in two files. A file is one row, and Spark's text writer moves it
to the store, whichever Spark knows, and commits it, so lost tasks leave nothing behind: the line separator that it puts behind the row
is the magic word with which Arrow files end.

Cases: null and empty texts are the end id alone; null ids stay null; repeated rows are written each, in the order of the texts' hashes; an
empty table gives no file and no row; further columns are ignored; special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborlens.llm.common import drop_path, fresh_path, slices, stored, table
from laborlens.llm.packing import word_ids

LENGTH = 2048
END_ID = 2
FILE_TOKENS = 1 << 22
BATCH = 256
MAGIC = b"ARROW1"


def arrow_file(ids: np.ndarray, docs: list, doc_type: pa.DataType, lengths: np.ndarray, length: int, shard: int, part: int) -> bytes:
    """One file: the ids of whole documents on end, and how many of them each document has (one at least)."""
    kind = pa.from_numpy_dtype(ids.dtype)
    rows = -(-len(ids) // length)
    flat = np.zeros(rows * length, ids.dtype)
    flat[: len(ids)] = ids
    mask = np.zeros(rows * length, bool)
    mask[: len(ids)] = True
    # one entry for each sequence that a document reaches into
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first, last = begins // length, (ends - 1) // length
    which = np.repeat(np.arange(len(docs)), last - first + 1)
    row = np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[which]
    at = np.maximum(begins[which], row * length)
    cuts = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    named = pa.array(docs, doc_type).take(pa.array(which))
    lists = [pa.ListArray.from_arrays(cuts, v) for v in (named, pa.array(at - begins[which], pa.int64()), pa.array(at - row * length, pa.int32()))]
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length), *lists]
    whole = pa.RecordBatch.from_arrays(columns, names=["ids", "mask", "doc_id", "doc_start", "offset"])
    whole = whole.replace_schema_metadata({"shard": str(shard), "part": str(part), "tokens": str(len(ids))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, whole.schema) as out:
        for i in range(0, rows, BATCH):
            out.write_batch(whole.slice(i, BATCH))
    return sink.getvalue().to_pybytes()


def write_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = "byte_bpe_50k.json",
    end_id: int = END_ID, file_tokens: int = FILE_TOKENS, kind: str = "uint16",
) -> None:
    """Writes the documents' ids below path, as integers of that kind; ids that don't fit it raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        most = np.iinfo(kind).max
        end = np.array([end_id], "<u4").tobytes()
        shard, part = TaskContext.get().partitionId(), 0
        names, tokens, held = [], [], 0

        def file(doc_type: pa.DataType) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens], np.int64)
            ids = np.concatenate(tokens)
            data = arrow_file(ids, names, doc_type, lengths, length, shard, part)
            return pa.RecordBatch.from_arrays([pa.array([data.removesuffix(MAGIC)], pa.binary())], names=["value"])

        doc_type = None
        for b in slices(batches):
            doc_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names.append(doc)
                wide = np.frombuffer((encode(text) if text else b"") + end, "<u4")
                if wide.max() > most:
                    raise ValueError(f"id {wide.max()} is no {kind}")
                tokens.append(wide.astype(kind))
                held += len(tokens[-1])
                if held >= file_tokens:
                    yield file(doc_type)
                    part += 1
                    names, tokens, held = [], [], 0
        if tokens:
            yield file(doc_type)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).withColumn("salt", F.rand(12))
    order = ["doc_id", "h", "salt"]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row for each document of the files: doc_id, shard, part, place (its ids before it in the file), n_tokens, ids_crc32. Sequences are
    viewed batch by batch; a digest is carried from one to the next. Masks and lengths that disagree raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_buffer()
                if not data.size:
                    continue  # what Spark writes where there is no row
                yield _documents(pa.ipc.open_file(pa.BufferReader(data)))

    schema = f"doc_id {id_type}, shard bigint, part bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _documents(file: pa.ipc.RecordBatchFileReader) -> pa.RecordBatch:
    told = file.schema.metadata
    names, places, sizes, digests, seen = [], [], [], [], 0
    for k in range(file.num_record_batches):
        batch = file.get_batch(k)
        length = batch.schema.field("ids").type.list_size
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
        full = pc.sum(batch.column("mask").flatten()).as_py()
        docs, starts, offsets = (batch.column(c) for c in ("doc_id", "doc_start", "offset"))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets.offsets.to_numpy()))
        at = rows * length + offsets.flatten().to_numpy()
        wide = ids[:full].astype("<u4")
        for doc, start, a, z in zip(docs.flatten().to_pylist(), starts.flatten().to_pylist(), at.tolist(), [*at[1:].tolist(), full], strict=True):
            if not start:
                names.append(doc)
                places.append(seen + a)
                sizes.append(0)
                digests.append(0)
            if sizes[-1] != start:
                raise ValueError(f"document {doc}: {sizes[-1]} ids where its list says {start}")
            digests[-1] = zlib.crc32(wide[a:z], digests[-1])
            sizes[-1] += z - a
        seen += full
    if seen != int(told[b"tokens"]):
        raise ValueError(f"{seen} ids where the file says {told[b'tokens'].decode()}")
    n, kind = len(names), file.schema.field("doc_id").type.value_type
    longs = [[int(told[b"shard"])] * n, [int(told[b"part"])] * n, places, sizes, digests]
    return pa.RecordBatch.from_arrays([pa.array(names, kind), *(pa.array(x, pa.int64()) for x in longs)], names=["doc_id", "shard", "part", "place", "n_tokens", "ids_crc32"])


def sequence(file: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence k of an opened file, as views of it."""
    batch, row = file.get_batch(k // BATCH), k % BATCH
    length = batch.schema.field("ids").type.list_size
    ids, mask = (batch.column(c).flatten().slice(row * length, length) for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before, to read_files(). Running sums see one row for each file of a shard, and one for each shard."""
    files = read.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    shards = files.groupBy("shard").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("of_shard"))
    files = files.select("shard", "part", before(Window.partitionBy("shard").orderBy("part")).alias("of_file")).join(shards, "shard")
    return read.join(files, ["shard", "part"]).withColumn("start", F.col("of_shard") + F.col("of_file") + F.col("place"))


def op12_fixed_size_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), path)
    read = stored(read_files(spark, path), "token-rows")
    drop_path(spark, path)
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
