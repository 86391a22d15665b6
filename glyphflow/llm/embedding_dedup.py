"""Embedding near-dedup through a pivot-permutation index.

1.  Equal vectors of one task are folded into one with a weight, so a group of copies has few rows.
2.  Pivots: vectors of a hash-ordered sample, none near another, chosen for each dimension; vectors of a dimension
    that the sample lacks take random directions.  Each vector is described by its nearest pivots, in order.
    Pivots are as many as the table needs, from PIVOTS up to MOST_PIVOTS or PIVOT_BYTES.  How many nearest ones
    describe a vector is found out on the sample: its vectors are turned at random until their cosine is the
    threshold, and the number grows until TARGET of them share two pivots with themselves as they were.  So recall
    holds where all vectors point one way, too.
3.  The inverted lists are kept by pairs of pivots: a vector enters the list of every pair among its own, so
    whatever meets in a list shares at least two pivots.  A pair of vectors is judged in the list of the two
    smallest pivots that it shares, once.
4.  Lists longer than BLOCK are dealt into chunks by a hash, and every pair of chunks is a block of its own.
    Blocks are verified by exact cosines in double precision and give sums of links, and a spanning forest; vectors
    that single precision holds exactly travel in it.

The sample is bounded and all vectors are indexed; the tests measure recall against brute force.

Defined cases: null vectors, null or non-finite components and zero vectors link with nothing and are their own
component; vectors of different dimensions do not link; rows that share an id, or have none, are vectors of
their own (each with a row of the result), and a component is named by the smallest id in it, null only if none
has one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .components import components
from .workspace import Workspace, keyed, owners_of, renamed

#: Pivots at least and at most, the bytes they may take, and the vectors for each one.
PIVOTS, MOST_PIVOTS, PIVOT_BYTES, EACH = 512, 8192, 32 << 20, 512
#: Vectors of a block.
BLOCK = 1024
COSINE = 0.95
#: Pivots are drawn from this many times as many vectors, and none has a larger cosine with an earlier one than this.
SAMPLE, APART = 4, 0.9
#: Share of turned vectors that must share two pivots, the fewest and most nearest pivots, and vectors that are turned.
TARGET, FEWEST, NEAREST, TURNED = 0.97, 5, 12, 512
#: Bytes of distinct vectors, and of the ids of equal ones, that a task holds for folding.
FOLD = 64 << 20

FOLDED = "vec_id long, rep long, weight long, vector binary"
LISTED = "key long, rep long, weight long, pivots binary, vector binary"
FOUND = "rep long, links long, least long"


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision, or None where it can link with nothing."""
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = None
        if x and None not in x:
            v = np.array(x, np.float64)
            if not np.isfinite(v).all() or not np.abs(v).max() > 0:
                v = None
        out.append(v)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pack(v: np.ndarray) -> bytes:
    """A vector's bytes, in single precision where that loses nothing; the first byte says which."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return b"f" + short.tobytes() if (short.astype(np.float64) == v).all() else b"d" + v.tobytes()


def dimension_of(packed: bytes) -> int:
    return (len(packed) - 1) // (4 if packed[:1] == b"f" else 8)


def unpack(packed: list[bytes]) -> np.ndarray:
    """Vectors of one dimension as rows in double precision."""
    return np.array([np.frombuffer(p, np.float32 if p[:1] == b"f" else np.float64, offset=1) for p in packed], np.float64)


def turned(x: np.ndarray, cosine: float, seed: int = 1) -> np.ndarray:
    """Rows of length 1 turned in directions at random, to this cosine with themselves."""
    noise = np.random.default_rng(seed).normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    return cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)


def nearest_needed(x: np.ndarray, pivots: np.ndarray, cosine: float = COSINE, target: float = TARGET) -> int:
    """How many nearest pivots describe a vector: the fewest with which ``target`` of the turned rows share two."""
    x = x[-TURNED:]  # the first ones are pivots themselves
    a, b = ranked_pivots(x, pivots, NEAREST), ranked_pivots(turned(x, cosine), pivots, NEAREST)
    for near in range(min(FEWEST, len(pivots)), min(NEAREST, len(pivots)) + 1):
        if ((a[:, :near, None] == b[:, None, :near]).sum(axis=(1, 2)) >= min(2, near)).mean() >= target:
            return near
    return min(NEAREST, len(pivots))


def choose_pivots(vectors: list[np.ndarray], most: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each dimension the first vectors that are apart from those chosen before; dimensions share by number."""
    by_size: dict[int, list[np.ndarray]] = {}
    for v in vectors:
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for dimension, found in by_size.items():
        x, chosen = unit(np.array(found)), []
        share = max(64, most * len(found) // len(vectors))
        for i in range(len(x)):
            if len(chosen) == share:
                break
            if not chosen or (x[chosen] @ x[i]).max() < APART:
                chosen.append(i)
        out[dimension] = x[chosen]
    return out


def numbers_needed(vectors: list[np.ndarray], pivots: dict[int, np.ndarray], cosine: float = COSINE) -> dict[int, int]:
    """nearest_needed for each dimension of a sample."""
    out = {}
    for dimension, p in pivots.items():
        own = [v for v in vectors if len(v) == dimension][-TURNED:]
        out[dimension] = nearest_needed(unit(np.array(own)), p, cosine)
    return out


def pivots_of(pivots: dict[int, np.ndarray], dimension: int) -> np.ndarray:
    """The pivots for vectors of this dimension; directions at random where the sample had none."""
    if dimension not in pivots:
        pivots[dimension] = unit(np.random.default_rng(dimension).normal(size=(64, dimension)))
    return pivots[dimension]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, list] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(i, ids[0], None, None) for ids in ([min(g), *g] for g in seen.values()) for i in ids[1:]]
        rows += [(None, min(g), len(g), v) for v, g in seen.items()]
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["vec_id", "rep", "weight", "vector"])
        seen.clear()

    for batch in batches:
        alone = []
        for i, v in zip(batch.column("vec_id").to_pylist(), _vectors(batch.column("embedding")), strict=True):
            if v is None:
                alone.append(i)
            else:
                packed = pack(v + 0.0)  # no negative zeros
                held += 16 if packed in seen else len(packed) + 200
                seen.setdefault(packed, []).append(i)
        if alone:
            n = len(alone)
            yield pa.RecordBatch.from_arrays([pa.array(alone, pa.int64()), pa.array(alone, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["vec_id", "rep", "weight", "vector"])
        if held > FOLD:
            yield from flush()
            held = 0
    if seen:
        yield from flush()


def ranked_pivots(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    near = min(near, len(pivots))
    found = [np.argsort(-(x[i : i + 512] @ pivots.T), axis=1, kind="stable")[:, :near] for i in range(0, len(x), 512)]
    return np.concatenate(found).astype(np.int32)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, near: int = FEWEST) -> np.ndarray:
    """The numbers of each row's nearest pivots, ascending."""
    near = min(near, len(pivots))
    found = [np.argpartition(-(x[i : i + 512] @ pivots.T), near - 1, axis=1)[:, :near] for i in range(0, len(x), 512)]
    return np.sort(np.concatenate(found), axis=1).astype(np.int32)


def pair_keys(near: np.ndarray, dimension: int = 0) -> np.ndarray:
    """The list of every pair of a row's pivots; a single pivot pairs with itself."""
    first = np.int64(dimension) << 32
    if near.shape[1] < 2:
        return first + (near.astype(np.int64) << 16) + near
    return np.stack([first + (near[:, a].astype(np.int64) << 16) + near[:, b] for a, b in combinations(range(near.shape[1]), 2)], axis=1)


def verify(rep: np.ndarray, weight: np.ndarray, near: np.ndarray, x: np.ndarray, key: int, side: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Links that each row of a block has in it, and the least row it is connected with there.

    side: of a block of two chunks, which of them a row is in; pairs inside a chunk have a block of their own.
    """
    link = (x @ x.T) >= cosine
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side[None, :]
    p, q = (key >> 16) & 0xFFFF, key & 0xFFFF
    for u in np.unique(near[(near < q) & (near != p)]):  # a smaller pair is shared: judged in its list
        has = (near == u).any(axis=1)
        link &= ~(has[:, None] & has[None, :])
    links = link @ weight
    label = rep.copy()
    while True:
        new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return links, label
        label = new


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least ``cosine``), component_id, kept for each row.

    pivots: how many; by default as the table needs.
    """
    spark = embeddings.sparkSession
    owners = owners_of(embeddings)
    with Workspace(spark, "vectors", batch_rows=2048) as ws:
        numbered, own = keyed(ws, embeddings.withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding")
        rows = numbered.select(F.col("row").alias("vec_id"), "embedding")
        longest, n = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
        room = PIVOT_BYTES // (8 * max(1, longest or 1))
        most = pivots or max(min(PIVOTS, room), min(n // EACH, MOST_PIVOTS, room))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * most).toArrow()  # SAMPLE * PIVOT_BYTES
        vectors = [v for v in _vectors(sample.column("embedding")) if v is not None] if sample.num_rows else []
        chosen = choose_pivots(vectors, most)
        shared = spark.sparkContext.broadcast((chosen, numbers_needed(vectors, chosen, cosine)))  # PIVOT_BYTES
        folded = ws.keep(rows.mapInArrow(_fold, FOLDED), "folded")
        reps = folded.where("vector is not null").select("rep", "weight", "vector")

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
            """For each dimension of a batch: the batch, its rows of that dimension, their pivots and lists."""
            pivots, needed = shared.value
            for b in batches:
                raw = b.column("vector").to_pylist()
                size = np.array([dimension_of(v) for v in raw], np.int64)
                for dimension in np.unique(size).tolist():
                    at = np.flatnonzero(size == dimension)
                    near = nearest_pivots(unit(unpack([raw[i] for i in at])), pivots_of(pivots, dimension), needed.get(dimension, NEAREST))
                    yield b, at, near, pair_keys(near, dimension)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, keys in index(batches):
                value, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["key", "n"])

        def enlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, at, near, keys in index(batches):
                k = keys.shape[1]
                row = pa.array(np.repeat(at, k))
                packed = pa.array([p.astype(np.uint16).tobytes() for p in near], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), b.column("rep").take(row), b.column("weight").take(row), packed, b.column("vector").take(row)], names=["key", "rep", "weight", "pivots", "vector"])

        long = reps.select("vector").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        long = long.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"), "n").where("n > 1")
        listed = reps.mapInArrow(enlist, LISTED).join(long, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        blocks = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        blocks = blocks.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        order = ["key", "i", "j"]
        dealt = blocks.repartition(owners, *order).sortWithinPartitions(*order)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at: tuple | None = None
            held: list[tuple] = []

            def close() -> pa.RecordBatch | None:
                if len(held) < 2:
                    return None
                rep, weight = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
                near = np.frombuffer(b"".join(h[2] for h in held), np.uint16).astype(np.int64).reshape(len(held), -1)
                x = unit(unpack([h[3] for h in held]))
                side = None if at[1] == at[2] else np.array([h[4] for h in held]) == at[1]
                links, least = verify(rep, weight, near, x, at[0], side, cosine)
                some = links > 0
                return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(least[some])], names=["rep", "links", "least"])

            for b in batches:
                for key, i, j, *rest in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "rep", "weight", "pivots", "vector", "chunk")), strict=True):
                    if (key, i, j) != at:
                        if (out := close()) is not None:
                            yield out
                        held, at = [], (key, i, j)
                    held.append(tuple(rest))
            if (out := close()) is not None:
                yield out

        found = ws.keep(dealt.select(*order, "rep", "weight", "pivots", "vector", "chunk").mapInArrow(judge, FOUND), "found")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        parts = components(ws, found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
        weights = reps.groupBy("rep").agg(F.max("weight").alias("weight"))
        members = folded.where("vector is null").select("vec_id", "rep").join(weights, "rep", "left").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
        component = F.coalesce("component", "rep")
        n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
        found = members.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
        return ws.result(renamed(found, numbered, own, "vec_id", "vec_id", "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
