"""Boxes that meet, on pages of any size, and boxes pushed below others along a sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a page from which on it is cut into cells, or swept.
MANY = 256
#: The smallest size that has a level of its own, and the farthest place that has cells of its own.
LEAST_SIZE, FAR = 2.0**-10, 1e12
#: The side of a level's cells is this many times that of the level below.
GROWTH = 4.0


def _level(size: Column) -> Column:
    """The level whose cells are as long as the size, or less than GROWTH times so."""
    return F.ceil(F.log(GROWTH, F.greatest(size, F.lit(LEAST_SIZE)))).cast("int")


def _cell(place: Column, level: Column) -> Column:
    return F.floor(F.greatest(F.least(place, F.lit(FAR)), F.lit(-FAR)) / F.pow(F.lit(GROWTH), level)).cast("long")


def meeting_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx_a, idx_b of boxes (keys, idx, x0, y0, x1, y1) of one group that overlap in both directions, once each.

    A grid for each pair of levels of width and height that the group has: a box is at home in the grid of its own
    size, where it covers four cells at most, and is entered in all coarser ones.  Two boxes meet in the one grid of
    the larger width and the larger height, where one of them is at home, or one by its width and the other by its
    height; there they are judged in the first cell that both cover.  So candidates are boxes near each other on the
    scale of the larger one, whatever the rest of the page looks like.  Boxes without numbers meet nothing.
    """
    low = lambda a, b: F.least(F.col(a), F.col(b))
    high = lambda a, b: F.greatest(F.col(a), F.col(b))
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    real = F.lit(True)
    for c in sides:
        real &= c.isNotNull() & ~F.isnan(c)
    own = boxes.where(real).withColumns({"lx": _level(high("x0", "x1") - low("x0", "x1")), "ly": _level(high("y0", "y1") - low("y0", "y1"))})
    levels = own.groupBy(*keys).agg(F.collect_set("lx").alias("xs"), F.collect_set("ly").alias("ys"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    entered = own.join(levels.withColumnsRenamed({k: f"_{k}" for k in keys}), same).drop(*[f"_{k}" for k in keys])
    entered = entered.withColumn("gx", F.explode(F.filter("xs", lambda level: level >= F.col("lx"))))
    entered = entered.withColumn("gy", F.explode(F.filter("ys", lambda level: level >= F.col("ly")))).drop("xs", "ys")
    gx, gy = F.col("gx"), F.col("gy")
    entered = entered.withColumns({"fx": _cell(low("x0", "x1"), gx), "fy": _cell(low("y0", "y1"), gy)})
    entered = entered.withColumn("cx", F.explode(F.sequence("fx", _cell(high("x0", "x1"), gx)))).withColumn("cy", F.explode(F.sequence("fy", _cell(high("y0", "y1"), gy))))
    by_x, by_y = F.col("lx") == gx, F.col("ly") == gy
    place = [*keys, "gx", "gy", "cx", "cy"]
    columns = ["idx", "x0", "y0", "x1", "y1", "fx", "fy"]

    def side(rows: DataFrame, n: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{n}_{c}") for c in [*place, *columns]], (by_x & by_y).alias(f"{n}_home"))

    a, b = F.col, F.col
    met = F.lit(True)
    for c in place:
        met &= a(f"a_{c}").eqNullSafe(b(f"b_{c}")) if c in keys else a(f"a_{c}") == b(f"b_{c}")
    first = (F.col("a_cx") == F.greatest("a_fx", "b_fx")) & (F.col("a_cy") == F.greatest("a_fy", "b_fy"))
    overlap = ~((a("a_x1") < b("b_x0")) | (a("a_x0") > b("b_x1"))) & ~((a("a_y1") < b("b_y0")) | (a("a_y0") > b("b_y1")))
    at_home = side(entered.where(by_x & by_y), "a").join(side(entered, "b"), met & first & overlap & F.when(F.col("b_home"), a("a_idx") < b("b_idx")).otherwise(a("a_idx") != b("b_idx")))
    crossed = side(entered.where(by_x & ~by_y), "a").join(side(entered.where(~by_x & by_y), "b"), met & first & overlap)
    pairs = at_home.unionByName(crossed)
    return pairs.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.least("a_idx", "b_idx").alias("idx_a"), F.greatest("a_idx", "b_idx").alias("idx_b"))


class Skyline:
    """The lowest end so far over each stretch of a line; both operations take a logarithm of its places."""

    def __init__(self, places: int) -> None:
        self.size = 1 << max(places - 1, 1).bit_length()
        self.best = [-np.inf] * (2 * self.size)  # of anything below a node
        self.whole = [-np.inf] * (2 * self.size)  # of what covers the node

    def _nodes(self, first: int, last: int) -> Iterator[int]:
        i, j = first + self.size, last + self.size + 1
        while i < j:
            if i & 1:
                yield i
                i += 1
            if j & 1:
                j -= 1
                yield j
            i, j = i >> 1, j >> 1

    def over(self, first: int, last: int) -> float:
        found = -np.inf
        for node in self._nodes(first, last):
            found = max(found, self.best[node])
        for node in (first + self.size, last + self.size):
            while node := node >> 1:
                found = max(found, self.whole[node])
        return found

    def put(self, first: int, last: int, end: float) -> None:
        for node in self._nodes(first, last):
            self.whole[node] = max(self.whole[node], end)
            while node and self.best[node] < end:
                self.best[node] = end
                node >>= 1


MOVED = "idx long, y0 double, end double"


def pushed_down(y0: np.ndarray, x0: np.ndarray, x1: np.ndarray, height: np.ndarray, gap: float) -> np.ndarray:
    """New tops of boxes in order: each below those before it that share a place of its width."""
    places = np.unique(np.concatenate([x0, x1]))
    first, last = np.searchsorted(places, x0), np.searchsorted(places, x1)
    line, out = Skyline(len(places)), np.empty(len(y0))
    for i, (a, b, y, h) in enumerate(zip(first.tolist(), last.tolist(), y0.tolist(), height.tolist(), strict=True)):
        y = max(y, line.over(a, b) + gap)
        out[i] = y
        line.put(a, b, y + h)
    return out


def sweep(pages: DataFrame, gap: float) -> DataFrame:
    """doc_id, page_number, idx, y0, end of pages (doc_id, page_number, items as layout lists them), a page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                items = batch.column("items")[i].values
                y0, x0, x1, h = (items.field(c).to_numpy(zero_copy_only=False) for c in ("y0", "x0", "x1", "h"))
                moved = pushed_down(y0, x0, x1, h, gap)
                n = len(moved)
                keys = [pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type) for c in ("doc_id", "page_number")]
                yield pa.RecordBatch.from_arrays([*keys, items.field("idx").cast(pa.int64()), pa.array(moved), pa.array(moved + h)], names=["doc_id", "page_number", "idx", "y0", "end"])

    kept = pages.schema
    ddl = f"doc_id {kept['doc_id'].dataType.simpleString()}, page_number {kept['page_number'].dataType.simpleString()}, {MOVED}"
    return pages.select("doc_id", "page_number", "items").mapInArrow(run, ddl)
