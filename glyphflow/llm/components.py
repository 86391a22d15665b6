"""Connected components of a table of links, by alternating large and small stars.

Every partition first shrinks its own links to a spanning forest.  Then each round hangs the larger
neighbours of a node, and after that its smaller ones, on the smallest node it knows, until nothing changes:
O(log**2) rounds of aggregations that combine before the shuffle.  No component is ever gathered anywhere, and
rounds are written to the workspace, so lost executors cost no earlier round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

_FOREST = 1 << 20


def spanning_forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node it is connected with) for every node but the smallest ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        forest = spanning_forest(held)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in forest], pa.int64()), pa.array([b for _, b in forest], pa.int64())], names=["a", "b"])

    for batch in batches:
        held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        if len(held) > _FOREST:
            yield out()
            held.clear()
    if held:
        yield out()


def components(ws: Workspace, links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b): node and component (the smallest node reachable) for every node that has a link."""
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_shrink, "a long, b long")
    edges = ws.keep(edges.distinct(), f"{name}-0")
    state, round_ = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == state:
            break
        state, round_ = now, round_ + 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(lowest.select("a", F.col("least").alias("b")))
        edges = ws.keep(small.where("a <> b").distinct(), f"{name}-{round_}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
