"""Exact deduplication through an extendible-hash index on shared files.

1.  Page files.  Each task folds equal texts of its own rows into one entry (comparing bytes, chaining
    entries whose 64-bit keys collide) and appends entries and row references to page files in the shared
    folder.  A group of copies, however large, thus has at most one entry for each task and flush.
2.  Directory.  The histogram of key prefixes, weighted by page bytes, drives directory doubling: an overfull
    bucket splits on its next key bit, and the directory doubles when that bit is beyond its depth.
3.  Owner tasks.  Each owner reads the entries of its buckets, which are key ranges, in key order.  Entries of
    one key form a chain of distinct texts; bytes are compared, so colliding keys never merge.
4.  Row references join their entry's class by entry id, which no hot text can skew.

Defined cases: null text counts as empty, and all texts without other characters than white space are equal;
rows repeated with one id are rows of their own, of which a group keeps one; a null id comes after all others
and is kept if the longest text has no other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .textbytes import WHITE, tidy
from .workspace import Workspace, owners_of

PAGES = "entry long, row long, doc_id long, key long, blob binary, sha string, n_chars long, n_rows long"
_PAGES = pa.schema([("entry", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("blob", pa.binary()), ("sha", pa.string()), ("n_chars", pa.int64()), ("n_rows", pa.int64())])
CLASSES = "entry long, keep_id long, keep_row long, group_size long, sha string"
_CLASSES = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])

#: Page bytes a bucket may hold before it splits, and the deepest directory (2**20 slots, 16 MB).
BUCKET_BYTES = 8 << 20
MAX_DEPTH = 20
#: A task's own table of entries is written out and begun anew at this size.
HELD_BYTES = 48 << 20


class Directory:
    """The directory of an extendible hash: slot (leading bits of a key) to bucket."""

    def __init__(self, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> None:
        self.bucket_bytes, self.max_depth = bucket_bytes, max_depth
        self.depth = 0
        self.slots = [0]
        self.local = [0]
        self.prefix = [0]

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in range(2)]
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Gives the half of the bucket whose next bit is 1 to a new bucket."""
        if self.local[bucket] == self.depth:
            self.double()
        self.local[bucket] += 1
        self.prefix[bucket] *= 2
        self.local.append(self.local[bucket])
        self.prefix.append(self.prefix[bucket] + 1)
        new, shift = len(self.local) - 1, self.depth - self.local[bucket]
        for slot in range(self.prefix[new] << shift, (self.prefix[new] + 1) << shift):
            self.slots[slot] = new
        return new

    def fill(self, histogram: dict[int, int], depth: int) -> Directory:
        """Splits overfull buckets; histogram: page bytes by the leading ``depth`` bits of the key."""
        total = [dict(histogram)]
        todo = [0]
        while todo:
            b = todo.pop()
            if sum(total[b].values()) <= self.bucket_bytes or self.local[b] >= min(depth, self.max_depth):
                continue
            new = self.split(b)
            bit = depth - self.local[b]
            total.append({k: v for k, v in total[b].items() if k >> bit & 1})
            total[b] = {k: v for k, v in total[b].items() if not k >> bit & 1}
            todo += [b, new]
        return self


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _write_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 36
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    chains: dict[int, list[list]] = {}
    held, entry, row = 0, task, task

    def flush() -> pa.RecordBatch:
        rows = [(e[5], e[6], e[3], k, e[0], e[1], e[2], e[4]) for k, chain in chains.items() for e in chain]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _PAGES, strict=True)], schema=_PAGES)

    for batch in batches:
        refs: list[tuple[int, int, int]] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            norm = text.encode().translate(None, WHITE)
            key = _signed(xxhash.xxh64_intdigest(norm))
            chain = chains.setdefault(key, [])
            for e in chain:
                if e[7] == len(norm) and unpack.decompress(e[0], max_output_size=len(norm) or 1) == norm:
                    e[4] += 1
                    if (-len(text), doc is None, doc or 0) < (-e[2], e[3] is None, e[3] or 0):
                        e[2], e[3], e[6] = len(text), doc, row
                    break
            else:
                e = [pack.compress(norm), hashlib.sha256(norm).hexdigest(), len(text), doc, 1, entry, row, len(norm)]
                chain.append(e)
                entry += 1
                held += len(e[0]) + 400
            refs.append((e[5], row, doc))
            row += 1
        if refs:
            a, b, c = (pa.array(x, pa.int64()) for x in zip(*refs, strict=True))
            yield pa.RecordBatch.from_arrays([a, b, c, *(pa.nulls(len(refs), t.type) for t in list(_PAGES)[3:])], schema=_PAGES)
        if held > HELD_BYTES:
            yield flush()
            chains.clear()
            held = 0
    if chains:
        yield flush()


def _rank(place: tuple) -> tuple:
    n_chars, no_id, doc, row = place
    return n_chars, no_id, doc or 0, row


def _resolve_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order in; the class of each entry out."""
    unpack = zstandard.ZstdDecompressor()
    at: int | None = None
    chain: list[dict] = []
    out: list[tuple] = []

    def close() -> None:
        for link in chain:
            _, _, keep, row = link["best"]
            out.extend((entry, keep, row, link["rows"], link["sha"]) for entry in link["entries"])
        chain.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _CLASSES, strict=True)], schema=_CLASSES)

    for batch in batches:
        for entry, row, doc, key, blob, sha, n_chars, n_rows in zip(*(batch.column(n).to_pylist() for n in _PAGES.names), strict=True):
            if key != at:
                close()
                at = key
            text = None
            for link in chain:
                if link["blob"] != blob:
                    text = unpack.stream_reader(blob).read() if text is None else text
                    if unpack.stream_reader(link["blob"]).read() != text:
                        continue
                link["entries"].append(entry)
                link["rows"] += n_rows
                link["best"] = min(link["best"], (-n_chars, doc is None, doc, row), key=_rank)
                break
            else:
                chain.append({"blob": blob, "sha": sha, "entries": [entry], "rows": n_rows, "best": (-n_chars, doc is None, doc, row)})
        if len(out) > 4096:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the longest original stays, then the smallest id.
    """
    spark = docs.sparkSession
    with Workspace(spark, "exact") as ws:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        pages = ws.keep(rows.mapInArrow(tidy(_write_pages), PAGES), "pages")
        entries = pages.where("blob is not null")
        size = F.octet_length("blob") + F.lit(96)
        total = entries.agg(F.sum(size)).first()[0] or 0
        deep = min(MAX_DEPTH, max(1, (total // bucket_bytes).bit_length() + 4))
        prefix = F.shiftrightunsigned(F.col("key"), 64 - deep)
        directory = Directory(bucket_bytes).fill({r[0]: r[1] for r in entries.groupBy(prefix.alias("p")).agg(F.sum(size)).collect()}, deep)
        # At most 2**MAX_DEPTH slots, 16 MB.
        slots = spark.createDataFrame(list(enumerate(directory.slots)), "slot long, bucket long")
        slot = F.shiftrightunsigned(F.col("key"), 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
        owned = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot").repartition(owners_of(docs), "bucket").sortWithinPartitions("key", "entry")
        classes = owned.select(*_PAGES.names).mapInArrow(tidy(_resolve_chains), CLASSES)
        members = pages.where("blob is null").select("entry", "row", "doc_id")
        found = members.join(classes, "entry").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
        return ws.result(found)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size,
    sha256(norm) AS text_sha256
  FROM d)
"""
