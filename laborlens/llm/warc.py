"""WARC archives by way of a chunked record table.

A record is a run of rows (record, chunk number, bytes): the payload is cut into chunks of at most CHUNK bytes as it is
written and read, and length and SHA-1 are carried from chunk to chunk, so no record is put together again. In the archive a
chunk is one WARC record: the first is a `response`, further ones are `continuation` segments (WARC-Segment-Number,
WARC-Segment-Origin-ID), the last tells WARC-Segment-Total-Length. A payload of LEAST_REVISIT bytes or more that occurs
again is stored once, with the largest id; the others are `revisit` records without a payload.

Spark's text writer and reader move the archives, so any store that Spark knows will do: rows end at CRLF when written,
and when read they begin at a header line that holds the archive's random id, which no payload can contain. Files are
gzipped, hence read by one task in order, each as large as one partition of the input makes it.

Cases: null html is an empty payload; null ids and urls are written as absent fields and come back null; rows that repeat
an id and payload are responses together if that id is the largest, else revisits; a group in which every id is null has
no largest and is all responses; an empty table gives no row; further columns are ignored; payloads may hold any bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import fresh_path, raw, slices, table

CHUNK = 1 << 18
LEAST_REVISIT = 1000
#: Slices of a group of copies, so that one payload with a third of all rows is joined by many tasks.
SALT = 16
CRLF = b"\r\n"


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload binary, digest, refers_to): refers_to is the id that the row revisits, else null."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), raw(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    held = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null")
    held = held.select("digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALT)).cast("int"))
    found = salted.join(held, ["digest", "salt"], "left")
    return found.select("id", "url", "payload", "digest", F.when(F.col("id").isNull() | (F.col("id") != F.col("kept")), F.col("kept")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, chunk: int = CHUNK) -> str:
    """Writes roles() as gzipped archives below path; gives the archive's id."""
    archive = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        out, held = [], 0
        for b in slices(batches, 64):
            for doc, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = f"urn:archive:{archive}:{part}:{number}"
                number += 1
                for row in _records(archive, name, doc, url, payload, digest, refers, chunk):
                    out.append(row)
                    held += len(row)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    return archive


def _records(archive: str, name: str, doc, url, payload: bytes, digest: str, refers, chunk: int) -> Iterator[bytes]:
    """The WARC records of one payload, less their last CRLF."""
    kind = "response" if refers is None else "revisit"
    view = memoryview(payload)
    pieces = [view[i : i + chunk] for i in range(0, len(view), chunk)] if refers is None else []
    so_far = hashlib.sha1()
    for k, piece in enumerate(pieces or [b""], 1):
        so_far.update(piece)
        head = [("WARC-Archive-ID", archive), ("WARC-Type", kind if k == 1 else "continuation"), ("WARC-Date", "1970-01-01T00:00:00Z")]
        head += [("WARC-Record-ID", f"<{name}:{k}>"), ("Content-Type", "text/html;charset=utf-8")]
        if doc is not None:
            head.append(("Page-ID", str(doc)))
        if url is not None and k == 1:
            head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
        if len(pieces) > 1:
            head.append(("WARC-Segment-Number", str(k)))
            if k > 1:
                head.append(("WARC-Segment-Origin-ID", f"<{name}:1>"))
            if k == len(pieces):
                head.append(("WARC-Segment-Total-Length", str(len(payload))))
        if refers is not None:
            head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers)), ("Payload-Length", str(len(payload)))]
        else:
            head.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(piece).digest()).decode()))
        # a single chunk or the last one knows the digest of the whole
        if k >= len(pieces):
            head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(so_far.digest() if refers is None else bytes.fromhex(digest)).decode()))
        head.append(("Content-Length", str(len(piece))))
        yield b"".join([b"WARC/1.1\r\n", *(f"{a}: {v}\r\n".encode("utf-8", "surrogateescape") for a, v in head), CRLF, piece, CRLF])


def read_chunks(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The chunked record table, in file order within each task: one row (header map, chunk number, bytes) a WARC record."""
    lines = spark.read.option("lineSep", f"WARC/1.1\r\nWARC-Archive-ID: {archive}\r\n").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            heads, numbers, data = [], [], []
            for line in b.column(0).to_pylist():
                if not line:
                    continue  # what precedes a file's first record
                end = line.index(b"\r\n\r\n")
                head = [tuple(x.split(": ", 1)) for x in line[:end].decode("utf-8", "surrogateescape").split("\r\n")]
                fields = dict(head)
                body = line[end + 4 : end + 4 + int(fields["Content-Length"])]
                if len(body) != int(fields["Content-Length"]) or line[end + 4 + len(body) :].strip(CRLF):
                    raise ValueError(f"{fields.get('WARC-Record-ID')}: the block is not as long as its header says")
                heads.append(head)
                numbers.append(int(fields.get("WARC-Segment-Number", 1)))
                data.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["header", "chunk", "data"])

    return lines.select(F.col("value").cast("binary")).mapInArrow(run, "header map<string,string>, chunk int, data binary")


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record of read_chunks(): id, url, payload_bytes, payload_digest (hex), record_type, refers_to,
    chunks. Length and digest come from the chunks as they pass; a revisit tells those of what it refers to."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]

    def whole(head: dict, n: int, digest: str, k: int) -> tuple:
        number = lambda x: None if x is None else int(x)
        return number(head.get("Page-ID")), head.get("WARC-Target-URI"), n, digest, head["WARC-Type"], number(head.get("Refers-To-Page-ID")), k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, so_far, n, total = None, None, 0, 0
        for b in slices(batches, 64):
            out = []
            for head, k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = dict(head)
                told = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex() if "WARC-Payload-Digest" in head else None
                if head["WARC-Type"] == "revisit":
                    out.append(whole(head, int(head["Payload-Length"]), told, 0))
                    continue
                if k == 1:
                    first, so_far, n, total = head, hashlib.sha1(), 0, 0
                elif first is None or head.get("WARC-Segment-Origin-ID") != first["WARC-Record-ID"] or k != total + 1:
                    raise ValueError(f"{head['WARC-Record-ID']}: a segment is missing before this one")
                so_far.update(data)
                n, total = n + len(data), k
                if told is not None:
                    if told != so_far.hexdigest():
                        raise ValueError(f"{first['WARC-Record-ID']}: the payload is not what its digest says")
                    out.append(whole(first, n, told, k))
                    first = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if first is not None:
            raise ValueError(f"{first['WARC-Record-ID']}: its last segment is missing")

    return chunks.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, chunks int")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    archive = write_archives(roles(table(spark, sf_dir, "pages")), path)
    return records(read_chunks(spark, path, archive)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k USING (d)
"""
