"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets of five-word shingles (64-bit hashes) with a Jaccard similarity of at least 3/4 differ in at most a
seventh of their sizes' sum.  A size band k allows H differences at most, so of the segments that the hash
universe is cut into, at most H hold different subsets.

1.  Every set is cut into the segments of its own band and of the next lower one.  Each non-empty subset gives
    a signature; who has more than H of them cannot miss a partner.  The number of segments is chosen for each
    band at least expected cost: signatures, plus the one-deletion neighbourhoods of sets left with too few.
    Those few give every subset with one shingle deleted too, to meet among themselves.
2.  Signatures travel packed to owner tasks by their hash, sorted and grouped there.  Small groups give all
    their pairs; a pair that shares fewer groups than the pigeonhole principle demands is no candidate.  Of
    large groups, only sets that may depend on them are considered: a set with more than H signatures outside
    of large groups meets every partner elsewhere.  Each of the rest is paired with the first of its groups.
    What that leaves in different components is paired by its rarest shingles, with the same guarantee.
3.  Candidates are verified by exact intersection of the two sets of shingle hashes, and components found by
    alternating stars.

Defined cases: null and empty texts, and those without words, have no shingles and are linked with nothing;
fewer than five words are one shingle; equal sets of one task are folded and linked; rows that share an id or
have none are documents of their own (each with a row of the result), and a component is named by the smallest
id in it, null only if none has one; an empty table gives an empty result; no column but doc_id and text is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .components import components
from .textbytes import as_bytes, chunks, mix, span_hashes, tidy, words
from .workspace import Workspace, keyed, owners_of, partitions, renamed

SHINGLE = 5
#: Groups of one signature up to this size give all their pairs; larger ones are treated in another exact way.
SMALL = 24
#: Signatures and documents that a task packs together; slices of an owner's signatures, which it takes one by one.
PACK_SIGNATURES, PACK_DOCS, SLICES = 3_000_000, 60_000, 4
#: Shingles of more than one in this many of a partition's share of all are met by a broadcast table.
HEAVY = 8
_STEP = [np.uint64(int(x) | 1) for x in np.random.default_rng(77).integers(1, 1 << 62, SHINGLE + 1)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    joined, start, end, doc = words(texts)
    w = span_hashes(joined, start, end)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    value = np.zeros(len(w), np.uint64)
    for k in range(SHINGLE):
        part = w[k:] * _STEP[k]
        inside = doc[k:] == doc[: len(doc) - k] if k else np.ones(len(w), bool)
        value[: len(part)][inside] += part[inside]
    value = mix(value + np.repeat(np.minimum(n, SHINGLE).astype(np.uint64), n) * _STEP[SHINGLE])
    return [np.unique(value[a : a + max(1, c - SHINGLE + 1)]) if c else value[:0] for a, c in zip(first[:-1].tolist(), n.tolist(), strict=True)]


@lru_cache(100_000)
def band(size: int) -> int:
    """The number of the band of sizes; of two linked sets, the larger one's band is the smaller one's or the next."""
    k, most = 0, 1
    while most < size:
        k, most = k + 1, max(most + 1, most * 4 // 3)
    return k


@lru_cache(10_000)
def plan(k: int) -> tuple[int, int]:
    """Segments of band k, and how many of them linked sets may differ in."""
    most, least = 1, 1
    for _ in range(k):
        least, most = most + 1, max(most + 1, most * 4 // 3)
    differ = (most + most * 4 // 3) // 7
    if not differ:
        return 1, 0
    best = None
    for m in range(differ + 1, 3 * differ + 24):
        cost = 0.0
        for n in (least, most):
            load = n / m
            empty = m * np.exp(-load)
            spread = np.sqrt(max(1e-9, empty * (1 - (1 + load) * np.exp(-load))))
            too_few = 1 / (1 + np.exp(1.7 * (m - empty - differ - 1) / spread))
            cost += m - empty + too_few * too_few * n * 50 + too_few * (n + m)
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1], differ


def signatures(values: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in band k (48 bits), and how many it may lose and still meet every partner."""
    m, differ = plan(k)
    segment = ((values >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    each = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    total = np.add.reduceat(each, start)
    salt = mix(segment[start] + np.uint64(k << 40))
    out, spare = mix(total ^ salt), len(start) - differ - 1
    if spare < 0:
        size = np.diff(np.concatenate([start, [len(values)]]))
        deep = mix(salt + np.uint64(1))
        fewer = mix((np.repeat(total, size) - each) ^ np.repeat(deep, size))
        # One difference allowed in a subset of two or more, none in one of one: if that adds up, no empty
        # subset need be a signature.
        enough = int(np.minimum(size, 2).sum()) > differ
        out = np.concatenate([out, mix(total ^ deep), fewer[np.repeat(size, size) > 1] if enough else fewer])
        if not enough:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), segment[start])
            out = np.concatenate([out, mix(mix(mix(empty + np.uint64(k << 40)) + np.uint64(1)))])
    return out >> np.uint64(16), spare


def families(size: int) -> tuple[int, ...]:
    """The bands a set of this size signs in: its own, and the lower one if a partner may be in it."""
    own = band(size)
    low = band(-(-size * 3 // 4))
    return (own,) if low == own else (own, low)


# -- signatures to owners -----------------------------------------------------------------------------------


def _sign(owners: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        folded: dict[bytes, int] = {}
        ids: list[int] = []
        spares: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        of: list[np.ndarray] = []
        rows: list[tuple[int, int, int]] = []
        count = 0

        def pack() -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=1)
            sig = np.concatenate(held) if held else np.zeros(0, np.uint64)
            doc = np.concatenate(of) if of else np.zeros(0, np.uint16)
            owner = (sig % np.uint64(owners * SLICES)).astype(np.int64)
            order = np.lexsort((sig, owner))
            sig, doc, owner = sig[order], doc[order], owner[order]
            cut = np.searchsorted(owner, np.arange(owners * SLICES + 1))
            table = np.array(ids, np.int64)
            low, high = np.array(spares, np.int64).reshape(-1, 2).T
            out = []
            for o in np.flatnonzero(np.diff(cut)):
                s, d = sig[cut[o] : cut[o + 1]], doc[cut[o] : cut[o + 1]]
                used, local = np.unique(d, return_inverse=True)
                head = np.array([len(s), len(used)], np.int64).tobytes()
                blob = head + table[used].tobytes() + low[used].astype(np.int32).tobytes() + high[used].astype(np.int32).tobytes()
                # The high halves are in order, so their steps take next to no space.
                high_steps = squeeze.compress(np.diff((s >> np.uint64(32)).astype(np.int64), prepend=0).astype(np.uint16).tobytes())
                blob += (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + local.astype(np.uint16).tobytes() + high_steps
                out.append((int(o) // SLICES, 1 + int(o) % SLICES, blob))
            if rows:
                out.append((task % owners, 0, squeeze.compress(np.array(rows, np.int64).tobytes())))
            for i in range(0, len(out), 64):
                o, kind, blob = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["owner", "kind", "blob"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            yield from pack()
            for x in (ids, spares, held, of, rows):
                x.clear()
            count = 0

        for docs, texts in chunks(batches, "doc_id"):
            for doc, values in zip(docs.tolist(), shingle_sets(texts), strict=True):
                if not len(values):
                    rows.append((doc, 0, doc))
                    if len(rows) >= 4 * PACK_DOCS:
                        yield from flush()
                    continue
                rep = folded.setdefault(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), doc)
                rows.append((doc, len(values), rep))
                if rep != doc:
                    if len(rows) >= 4 * PACK_DOCS:
                        yield from flush()
                    continue
                signed = [signatures(values, k) for k in families(len(values))]
                for s, _ in signed:
                    held.append(s)
                    of.append(np.full(len(s), len(ids), np.uint16))
                    count += len(s)
                ids.append(doc)
                spares.append((min(x for _, x in signed), len(values)))
                if count > PACK_SIGNATURES or len(ids) == PACK_DOCS:
                    yield from flush()
            if len(folded) > 500_000:
                folded.clear()
        yield from pack()

    return sign


GROUPED = "kind int, a long, b long, n long, need long"


def _pairs_of(doc: np.ndarray, size: np.ndarray, spare: np.ndarray, start: np.ndarray, length: np.ndarray, small: int) -> tuple[np.ndarray, ...]:
    """The pairs inside small groups whose sizes allow a link: documents, groups shared, and groups needed."""
    found = [np.zeros((4, 0), np.int64)]
    for g in np.unique(length[(length > 1) & (length <= small)]):
        at = start[length == g]
        for i, j in combinations(range(int(g)), 2):
            a, b = at + i, at + j
            x, y = size[a], size[b]
            ok = (np.minimum(x, y) * 4 >= np.maximum(x, y) * 3) & (doc[a] != doc[b])
            a, b = a[ok], b[ok]
            found.append(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), np.where(doc[a] < doc[b], spare[a], spare[b]), np.where(doc[a] < doc[b], spare[b], spare[a])]))
    a, b, p, q = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b, p, q = a[order], b[order], p[order], q[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    # Both spares in one number; each is less than 2**31 and may be negative.
    return a[at], b[at], np.diff(np.concatenate([at, [len(a)]])), (p[at] << 32) + (q[at] + (1 << 31))


def _group(small: int):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs in the order of their owners and slices in; documents (0), pairs (1) and members of large groups (2) out."""
        at: tuple[int, int] | None = None
        held: list[bytes] = []

        def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            need = np.zeros(len(a)) if need is None else need
            for i in range(0, len(a), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[s]), kind, np.int32)), *(pa.array(x[s].astype(np.int64)) for x in (a, b, n, need))], names=["kind", "a", "b", "n", "need"])

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sigs, docs, spares, sizes = [], [], [], []
            for blob in held:
                n, m = np.frombuffer(blob, np.int64, 2)
                at_ = 16
                parts = []
                for kind, c in ((np.int64, m), (np.int32, m), (np.int32, m), (np.uint32, n), (np.uint16, n)):
                    parts.append(np.frombuffer(blob, kind, int(c), at_))
                    at_ += int(c) * np.dtype(kind).itemsize
                table, spare, size, low, local = parts
                high = np.cumsum(np.frombuffer(unpack.decompress(blob[at_:]), np.uint16).astype(np.uint64))
                sigs.append(low.astype(np.uint64) | high << np.uint64(32))
                docs.append(table[local])
                spares.append(spare[local])
                sizes.append(size[local])
            sig, doc, spare, size = (np.concatenate(x) for x in (sigs, docs, spares, sizes))
            order = np.lexsort((doc, sig))
            sig, doc, spare, size = sig[order], doc[order], spare[order], size[order]
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            length = np.diff(np.concatenate([start, [len(sig)]]))
            yield from rows(1, *_pairs_of(doc, size.astype(np.int64), spare.astype(np.int64), start, length, small))
            for s, g in zip(start[length > small].tolist(), length[length > small].tolist(), strict=True):
                yield from rows(2, np.full(g, int(sig[s]), np.int64), doc[s : s + g], spare[s : s + g])
            held.clear()

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for owner, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("owner", "kind", "blob")), strict=True):
                if kind == 0:
                    table = np.frombuffer(unpack.decompress(blob), np.int64).reshape(-1, 3)
                    yield from rows(0, table[:, 0], table[:, 2], table[:, 1])
                    continue
                if (owner, kind) != at:
                    yield from close()
                    at = owner, kind
                held.append(blob)
        yield from close()

    return group


# -- verification -------------------------------------------------------------------------------------------


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pack.compress(t) for t in as_bytes(b.column("text"))], pa.binary())], names=["doc_id", "blob"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        sets = shingle_sets([unpack.decompress(x) for x in b.column("blob").to_pylist()])
        size = np.array([len(s) for s in sets], np.int64)
        doc = np.repeat(np.array(b.column("doc_id").to_pylist(), np.int64), size)
        token = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        n = np.repeat(size, size)
        for i in range(0, len(doc), 1 << 15):
            s = slice(i, i + (1 << 15))
            yield pa.RecordBatch.from_arrays([pa.array(token[s]), pa.array(doc[s]), pa.array(n[s])], names=["token", "doc_id", "size"])


def similar(a: np.ndarray, b: np.ndarray, share: int = 75) -> bool:
    """Whether 100 * intersection >= share * union, of sorted distinct values."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= share * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        blobs = dict(zip(a, batch.column("x").to_pylist(), strict=True)) | dict(zip(b, batch.column("y").to_pylist(), strict=True))
        sets = dict(zip(blobs, shingle_sets([unpack.decompress(x) for x in blobs.values()]), strict=True))
        ok = [i for i in range(len(a)) if similar(sets[a[i]], sets[b[i]])]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], names=["a", "b"])


def _linked(ws: Workspace, texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs that are linked; b is joined first, since one a may have very many b."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("blob").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("blob").alias("y"))
    return ws.keep(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(tidy(_verify), "a long, b long"), name)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    p = parts.select(F.col("node").alias("a"), F.col("component").alias("pa"))
    q = parts.select(F.col("node").alias("b"), F.col("component").alias("pb"))
    return pairs.join(p, "a", "left").join(q, "b", "left").where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")


def _by_rare_shingles(ws: Workspace, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates among sets of many large groups, from their rarest shingles.

    In the order of rarity, the first n - ceil(6n/7) + 1 shingles of the smaller of two linked sets and the
    first n - ceil(3n/4) + 1 of the larger have one in common, and behind it there is room for what else they
    must share.  Sets meet by shingle and by band of sizes, in which a partner is at most one band up.  Of those
    that meet only sets of different components are paired, and the most frequent component's members not with
    each other.
    """
    tokens = ws.keep(texts.mapInArrow(tidy(_tokens), "token long, doc_id long, size long"), "tokens")
    common = ws.keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    # A shingle of a large share of all rows would be one task's join: those, fewer than HEAVY for each partition, are broadcast.
    share = max(2, tokens.count() // (HEAVY * partitions(ws.spark)))
    heavy, light = common.where(F.col("df") > share), common.where(F.col("df") <= share)
    named = tokens.join(F.broadcast(heavy.withColumnRenamed("df", "heavy")), "token", "left")
    met = named.where("heavy is not null").withColumnRenamed("heavy", "df").union(named.where("heavy is null").drop("heavy").join(light, "token"))
    by_rarity = Window.partitionBy("doc_id").orderBy("df", "token")
    alone = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    placed = met.withColumn("pos", alone + F.row_number().over(by_rarity)).where("pos <= size - (3 * size + 3) div 4 + 1")
    placed = placed.join(parts, F.col("doc_id") == F.col("node"), "left")
    entries = placed.select("token", "doc_id", "size", "pos", F.coalesce("component", "doc_id").alias("part"), F.expr("pos <= size - (6 * size + 6) div 7 + 1").alias("first"))
    entries = ws.keep(entries, "entries")
    band_of = lambda size: F.floor(F.log(size) / np.log(4 / 3)).cast("int")
    larger = entries.withColumns({"band": band_of(F.col("size")), "role": F.lit("s")})
    # A smaller set's partners have at most 4/3 of its size, so their bands are these.
    smaller = entries.where("first").withColumns({"band": F.explode(F.sequence(band_of(F.col("size")), band_of(F.expr("4 * size div 3")))), "role": F.lit("r")})
    roles = larger.unionByName(smaller)
    sizes = roles.groupBy("token", "band", "part").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("role") == "r").alias("r"), F.max(F.col("role") == "s").alias("s"))
    mixed = sizes.groupBy("token", "band").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("r").alias("r"), F.max("s").alias("s"))
    held = ws.keep(roles.join(mixed.where("parts > 1 AND r AND s").select("token", "band", "main"), ["token", "band"]), "met")
    side = lambda role, where: held.where(F.col("role") == role).where(where).select("token", "band", *[F.col(x).alias(f"{role}_{x}") for x in ("doc_id", "size", "pos", "part")])
    room = "4 * r_size >= 3 * s_size AND 7 * (1 + least(r_size - r_pos, s_size - s_pos)) >= 3 * (r_size + s_size)"
    order = "(r_size < s_size OR (r_size = s_size AND r_doc_id < s_doc_id)) AND r_part <> s_part"
    one = side("r", "part <> main").join(side("s", "true"), ["token", "band"]).where(f"{order} AND {room}")
    two = side("r", "part = main").join(side("s", "part <> main"), ["token", "band"]).where(f"{order} AND {room}")
    return one.union(two).select(F.least("r_doc_id", "s_doc_id").alias("a"), F.greatest("r_doc_id", "s_doc_id").alias("b")).distinct()


def jaccard_join(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    owners = owners_of(docs)
    with Workspace(spark, "jaccard") as ws:
        numbered, own = keyed(ws, docs.withColumn("text", F.col("text").cast("string")), "doc_id", "text")
        rows = numbered.select(F.col("row").alias("doc_id"), "text")
        signed = rows.mapInArrow(tidy(_sign(owners)), "owner int, kind int, blob binary")
        grouped = ws.keep(signed.repartition(owners, "owner").sortWithinPartitions("owner", "kind").mapInArrow(tidy(_group(small)), GROUPED), "grouped")
        found = grouped.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("rep"))
        # Sets that large groups may leave with too few signatures: the spare is the lesser of its two bands'
        # and all its large groups count against it.
        large = grouped.where("kind = 2").select(F.col("a").alias("gid"), F.col("b").alias("member"), F.col("n").alias("spare"))
        counts = ws.keep(large.groupBy("member").agg(F.count(F.lit(1)).alias("large"), F.min("spare").alias("spare")), "counts")
        bound = counts.where("large > spare").select("member")
        # Two linked sets differ in few segments, so besides large groups they share more than each one's spare.
        shared = grouped.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        shared = shared.select("a", "b", "n", F.shiftright("need", 32).alias("p"), (F.col("need").bitwiseAND(0xFFFFFFFF) - (1 << 31)).alias("q"))
        many = shared.join(counts.select(F.col("member").alias("a"), F.col("large").alias("l")), "a", "left").join(counts.select(F.col("member").alias("b"), F.col("large").alias("m")), "b", "left")
        enough = lambda spare, large: F.col("n") > F.col(spare) - F.coalesce(large, F.lit(0))
        pairs = ws.keep(many.where(enough("p", "l") & enough("q", "m")).select("a", "b"), "pairs")
        # Each set of large groups with the first of its groups' firsts.
        held = large.select("gid", "member").join(bound, "member")
        first = held.groupBy("gid").agg(F.min("member").alias("a"))
        stars = ws.keep(held.join(first, "gid").groupBy(F.col("member").alias("b")).agg(F.min("a").alias("a")).where("a <> b").select("a", "b"), "stars")
        named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(stars.select("a")).union(stars.select("b")).union(bound).distinct()
        zipped = rows.mapInArrow(_zipped, "doc_id long, blob binary")
        texts = ws.keep(zipped.join(named, "doc_id", "left_semi"), "texts")
        links = found.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = links.union(_linked(ws, texts, stars, "links-1"))
        parts = components(ws, links, "first")
        links = links.union(_linked(ws, texts, _apart(pairs, parts), "links-2"))
        parts = components(ws, links, "second")
        if bound.limit(1).count():
            rare = _by_rare_shingles(ws, texts.join(bound.select(F.col("member").alias("doc_id")), "doc_id", "left_semi"), parts)
            parts = components(ws, links.union(_linked(ws, texts, rare, "links-3")), "third")
        joined = found.join(parts, F.col("doc_id") == F.col("node"), "left")
        return ws.result(renamed(joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), numbered, own, "doc_id", "doc_id", "component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))
