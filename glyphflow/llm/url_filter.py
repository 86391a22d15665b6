"""URL filtering by a sorted digest array.

The rules' strings (host and path prefix, like ``example.org/es/``) are hashed to 64-bit xxhash keys and
sorted.  A worker maps the array into memory from a file in its own temporary folder, hashes every candidate
string of its URLs (each host suffix with each path prefix of a length that some rule has), finds them all
with one vectorised binary search, and confirms each hit by comparing the stored string, so colliding digests
never decide.  The array is broadcast up to INDEX_BYTES; a longer list is joined on the digest instead.

Defined cases: a URL that is null, or has no ``://``, has empty host and path and no rule; rows repeated or
with null ids are judged like any other; of rules that fit equally long, the first by code point wins; an
empty table or an empty list gives no rule; no column but page_id and url is read.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: What the method says of a URL that no rule fits.
DEFAULT = "allow"
#: Largest array that is broadcast.
INDEX_BYTES = 64 << 20

OUT = "page_id long, host string, path string, rule string, verdict string"
_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    found = _SPLIT.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[str]:
    """Each suffix of the host of so many labels, with each prefix of the path of these lengths; longest first."""
    if not host or not labels:
        return []
    last = host.rsplit(".", max(labels))
    have = len(last) if len(last) <= max(labels) else max(labels)
    suffixes = [".".join(last[-k:]) for k in labels if k <= have]
    return sorted((s + path[:n] for s in suffixes if s for n in lengths if n <= len(path)), key=lambda c: (-len(c), c))


class SortedDigests:
    """Digests in order, and their strings and verdicts in the same order."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = sorted(dict(rules).items(), key=lambda r: xxhash.xxh64_intdigest(r[0]))
        self.digests = np.array([xxhash.xxh64_intdigest(r) for r, _ in self.rules], "<u8").tobytes()
        hosts = [r.partition("/")[0] for r, _ in self.rules]
        self.lengths = sorted({len(r) - len(h) for (r, _), h in zip(self.rules, hosts, strict=True)})
        self.labels = sorted({h.count(".") + 1 for h in hosts})
        self._mapped: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_mapped": None}

    @property
    def size(self) -> int:
        return sum(len(r) + len(v) + 8 for r, v in self.rules)

    def mapped(self) -> np.ndarray:
        """The digests as a memory map; the file's name goes at once, the map stays."""
        if self._mapped is None:
            handle, path = tempfile.mkstemp(suffix=".digests")
            with os.fdopen(handle, "wb") as f:
                f.write(self.digests or bytes(8))
            self._mapped = np.memmap(path, "<u8", "r")[: len(self.rules)]
            os.unlink(path)
        return self._mapped

    def find(self, probes: list[list[str]]) -> list[tuple[str, str] | None]:
        """For each list of candidates, longest first: the first that is a rule, with its verdict."""
        flat = [c for cs in probes for c in cs]
        digests = self.mapped()
        if not flat or not len(digests):
            return [None] * len(probes)
        keys = np.array([xxhash.xxh64_intdigest(c) for c in flat], np.uint64)
        at = np.searchsorted(digests, keys)
        hit = digests[np.minimum(at, len(digests) - 1)] == keys
        out, i = [], 0
        for cs in probes:
            out.append(next((r for j, c in enumerate(cs, i) if hit[j] and (r := self.confirm(int(at[j]), c))), None))
            i += len(cs)
        return out

    def confirm(self, at: int, text: str) -> tuple[str, str] | None:
        """The rule with this very string among those of one digest."""
        digests = self.mapped()
        key = digests[at]
        while at < len(digests) and digests[at] == key:
            if self.rules[at][0] == text:
                return self.rules[at]
            at += 1
        return None


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | tuple = RULES, default: str = DEFAULT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null), verdict (the rule's, else ``default``)."""
    index = SortedDigests(list(rules))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if index.size > index_bytes:
        return _judge_by_join(rows, index, default)
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            best = found.find([candidates(h, p, found.lengths, found.labels) for h, p in parts])
            columns = [[h for h, _ in parts], [p for _, p in parts], [b and b[0] for b in best], [b[1] if b else default for b in best]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], schema=_OUT)

    return rows.mapInArrow(judge, OUT)


def _judge_by_join(rows: DataFrame, index: SortedDigests, default: str) -> DataFrame:
    """The same for a list too long to broadcast: candidates meet the rules on their digest and string."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(r, v) for r, v in index.rules], "rule string, verdict string").withColumn("rule_digest", F.xxhash64("rule"))
    lengths, labels = index.lengths, index.labels

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            probes = [candidates(h, p, lengths, labels) for h, p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]), pa.array(probes, pa.list_(pa.string()))], names=["page_id", "host", "path", "probes"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([b.column("row"), *p.columns], names=["row", *p.schema.names]) for b in batches for p in probe(iter([b]))),
        "row long, page_id long, host string, path string, probes array<string>",
    )
    tried = numbered.select("row", "page_id", "host", "path", F.explode_outer("probes").alias("probe"))
    met = tried.withColumn("digest", F.xxhash64("probe")).join(table, (F.col("digest") == F.col("rule_digest")) & (F.col("probe") == F.col("rule")), "left")
    best = met.groupBy("row", "page_id", "host", "path").agg(F.min(F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), "rule", "verdict"))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, instr(url, '://') AS cut, substr(url, instr(url, '://') + 3) AS rest FROM pages),
q AS (
  SELECT page_id,
    CASE WHEN coalesce(cut, 0) = 0 THEN '' ELSE translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN coalesce(cut, 0) = 0 THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path
  FROM p),
r(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id
"""
