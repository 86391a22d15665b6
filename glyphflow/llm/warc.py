"""WARC archives: a deterministic sharded writer, and a reader of what it has committed.

1.  An index of light rows (id, digests and length of the payload) says which record is the first of its payload;
    the others become revisits of it.  Groups of copies are counted map-side, and meet the index in a join of two
    written tables whose hot keys Spark splits.
2.  Records are range-sorted by page id.  Distributed prefix sums of record sizes cut that order into shards, so
    shards depend on the data alone and not on partitions, tasks or samples.
3.  One shuffle brings pages and their decisions together by shard; a task writes a shard's records in order, each
    a gzip member with headers and digests made anew from the bytes, and rolls to the next file once the compressed
    size is reached.
4.  A file is written under a temporary name and renamed when it is whole.  The manifest, a table of the files with
    their lengths and digests, is written by Spark's own commit after all of them.  Readers open the files of the
    manifest only, so a task or job that died leaves nothing that is read, and a repeated one gives the same bytes.

Defined cases: null html is an empty payload; a null page_id comes after all others, and its records carry no id;
rows repeated or with one id are records of their own; a null url gives no target, and white space and control
characters of a url are percent-encoded; equal payloads are told by their SHA-256; an empty table gives an empty
manifest and no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import PENDING, Pending, store
from ..sources.tables import read
from .textbytes import tidy
from .workspace import Workspace, numbered, partitions

#: Bytes of records before compression that a shard holds; more where there would be more than MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 16
#: Share of a shard's bytes at which a file, compressed, is closed and the next begun.
FILE_SHARE = 0.25
#: What headers add to a record, about.
HEADERS = 700
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, shard int, n_records long, n_bytes long, sha256 string"
_MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
RECORDS = "page_id long, url string, record_type string, record_id string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(row: int, digest: str) -> str:
    """The same for the same row and payload, whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row}/{digest}')}>"


def member(fields: list[tuple[str, str | int | None]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(row: int, page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, int | None] | None, date: str) -> bytes:
    """refers: the row and page_id of the response that this one revisits."""
    digest = digest_of(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if refers else payload)
    revisit = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers[0], digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", refers[1])] if refers else []
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(row, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", url)),
        *revisit,
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("X-Payload-Length", len(payload)),
        ("X-Page-ID", page_id),
    ]
    return member(fields, block)


class Roll:
    """The files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str) -> None:
        self.folder, self.shard, self.file_bytes, self.date = folder, shard, file_bytes, date
        self.number, self.records = 0, 0
        self.file: Pending | None = None

    def add(self, data: bytes) -> tuple | None:
        """Writes a record; the manifest's row where that fills the file."""
        if self.file is None:
            self.name, self.sha = f"part-{self.shard:05d}-{self.number:05d}.warc.gz", hashlib.sha256()
            self.file = Pending(self.folder, self.name)
            info = b"software: glyphflow\r\nformat: WARC File Format 1.1\r\n"
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.number, self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(data)
        self.records += 1
        return self.close() if self.file.n_bytes >= self.file_bytes else None

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)

    def close(self) -> tuple | None:
        if self.file is None:
            return None
        self.file.commit()
        row = (self.name, self.shard, self.records, self.file.n_bytes, self.sha.hexdigest())
        self.number, self.records, self.file = self.number + 1, 0, None
        return row


def _decisions(ws: Workspace, rows: DataFrame, min_bytes: int) -> DataFrame:
    """row, of_row, of_page (of the response that it revisits, or null), size."""
    payload = F.col("payload")
    index = ws.keep(rows.select("row", "page_id", F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"), F.coalesce(F.octet_length("url"), F.lit(0)).alias("n_url")), "index")
    groups = index.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min(F.struct("row", "page_id")).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = ws.keep(groups.select("digest", "of"), "firsts")
    again = (F.col("of.row") < F.col("row")) & (F.col("n_bytes") >= min_bytes)
    size = F.when(again, 0).otherwise(F.col("n_bytes")) + F.col("n_url") + HEADERS
    return index.join(firsts, "digest", "left").select("row", F.when(again, F.col("of.row")).alias("of_row"), F.when(again, F.col("of.page_id")).alias("of_page"), size.alias("size"))


def shard_starts(ws: Workspace, sized: DataFrame, shard_bytes: int) -> tuple[list[int], int]:
    """The first row of each shard (at most MOST_SHARDS + 1) in the order of rows, and the bytes of a shard.

    Prefix sums of size in two steps: totals of ranges of rows, then sums inside each range.
    """
    ranged = ws.keep(sized.select("row", "size").repartitionByRange(partitions(ws.spark), "row").withColumn("part", F.spark_partition_id()), "ranged")
    start, starts = 0, []
    for part, size in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("size")).collect())):  # a number for each range
        starts.append((part, start))
        start += size
    if not starts:
        return [], shard_bytes
    shard_bytes = max(shard_bytes, -(-start // MOST_SHARDS))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(inside, F.lit(0)) + F.col("start")
    placed = ranged.join(F.broadcast(ws.spark.createDataFrame(starts, "part int, start long")), "part").withColumn("before", before)
    firsts = placed.groupBy(F.expr(f"before div {shard_bytes}")).agg(F.min("row").alias("row"))
    return sorted(r.row for r in firsts.collect()), shard_bytes


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int | None = None, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in ``folder``; returns the manifest as read back.

    Of equal payloads of at least min_bytes the first is a response and the others revisit it.
    """
    spark = pages.sparkSession
    with Workspace(spark, "warc", batch_rows=256) as ws:
        light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
        rows, _ = numbered(ws, light, "page_id", F.struct("payload", "url"), "row")
        decisions = ws.keep(_decisions(ws, rows, min_bytes), "decisions")
        starts, shard_bytes = shard_starts(ws, decisions, shard_bytes)
        firsts = spark.sparkContext.broadcast(np.array(starts, np.int64))
        full = file_bytes or int(shard_bytes * FILE_SHARE)

        @F.pandas_udf("int")
        def shard_of(row: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(firsts.value, row.to_numpy(), "right") - 1)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roll: Roll | None = None
            refers = None

            def listed(row: tuple | None) -> Iterator[pa.RecordBatch]:
                if row:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _MANIFEST, strict=True)], schema=_MANIFEST)

            try:
                for batch in batches:
                    for i in range(len(batch)):
                        shard, row, kind, of_row, of_page, page_id, url, payload = (batch.column(c)[i].as_py() for c in ("shard", "row", "kind", "of_row", "of_page", "page_id", "url", "payload"))
                        if kind == 0:
                            refers = None if of_row is None else (of_row, of_page)
                            continue
                        if roll is None or roll.shard != shard:
                            yield from listed(roll and roll.close())
                            roll = Roll(folder, shard, full, date)
                        yield from listed(roll.add(page_record(row, page_id, url, payload, refers, date)))
                yield from listed(roll and roll.close())
                roll = None
            finally:
                if roll is not None and roll.file is not None:
                    roll.file.abort()

        none = F.lit(None)
        decided = decisions.select(shard_of("row").alias("shard"), "row", F.lit(0).alias("kind"), "of_row", "of_page", none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("binary").alias("payload"))
        heavy = rows.select(shard_of("row").alias("shard"), "row", F.lit(1).alias("kind"), none.cast("long").alias("of_row"), none.cast("long").alias("of_page"), "page_id", "url", "payload")
        dealt = decided.unionByName(heavy).repartition(max(1, min(len(starts), 4 * partitions(spark))), "shard").sortWithinPartitions("shard", "row", "kind")
        path = f"{folder.rstrip('/')}/manifest"
        dealt.mapInArrow(tidy(write), MANIFEST).write.mode("errorifexists").parquet(path)
        _clear(spark, f"{folder.rstrip('/')}/{PENDING}")
        firsts.destroy()
        return spark.read.schema(MANIFEST).parquet(path)


def _clear(spark: SparkSession, path: str) -> None:
    """What attempts that died have left."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        if not data:
            data = stream.read(chunk)
    if parts:
        raise ValueError("the last record is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if not version.startswith("WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"not a record of {n} bytes: {head[:200]!r}")
    return fields, rest[:n]


def page_of(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of RECORDS; digests that do not fit the bytes are an error."""
    if fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (digest_of(payload), len(payload)) != (digest, n):
        raise ValueError(f"payload digest of {fields['warc-record-id']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("x-page-id"), fields.get("warc-target-uri"), kind, fields["warc-record-id"], fields["warc-date"], n, digest, number("x-refers-to-page-id"), payload if payloads else None


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the folder's manifest names; revisits have no payload of their own.

    A file is read by one task, a record at a time, and must have the length and records that the manifest says.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        for batch in batches:
            for name, wanted in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                rows, n, held = [], 0, 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        rows.append(page_of(fields, block, payloads))
                        n, held = n + 1, held + (len(block) if payloads else 0)
                        if len(rows) == 1024 or held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if n != wanted:
                    raise ValueError(f"{name} has {n} records, the manifest says {wanted}")
                if rows:
                    yield _batch(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    return manifest.repartition(partitions(spark)).mapInArrow(tidy(records), RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark, "archives") as ws:
        write_warc(read(spark, sf_dir, "pages"), f"{ws.root}/warc")
        found = read_warc(spark, f"{ws.root}/warc", payloads=False)
        return ws.result(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) // [32768, 1024, 32, 1][i % 4 + 1]) % 32 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
