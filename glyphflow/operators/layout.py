"""Lines of recognised words, classes of font size, overlapping boxes, and pages of flowing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shaping import lines_to_width
from ..functions.text import is_blank
from .overlaps import MANY, meeting_boxes, sweep

#: Pixels between the tops of words from which a new line begins, and the confidence of words without any, by engine.
ENGINES = {"vision": (20, 90.0), "easy": (30, 85.0)}
TESSERACT_DEFAULT = 0.0
#: Vertical gap between blocks, smallest block, padding and font size of the placed translation.
GAP, LEAST_WIDTH, LEAST_HEIGHT, PADDING, SIZE = 8.0, 20.0, 10.0, 2.0, 11.0


def _line(order: list[Column], default: float, dpi: int) -> list[Column]:
    """Text, box in points and mean confidence of the words of a line."""
    scale = F.lit(72.0 / dpi)
    word = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("text").alias("t"))
    return [
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["t"]), " ").alias("raw_text"),
        (F.min("left") * scale).alias("x0"),
        (F.min("top") * scale).alias("y0"),
        (F.max(F.col("left") + F.col("width")) * scale).alias("x1"),
        (F.max(F.col("top") + F.col("height")) * scale).alias("y1"),
        (F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(default)) / 100.0).alias("confidence"),
    ]


def lines_by_number(words: DataFrame, dpi: int = 300) -> DataFrame:
    """One line for each (block_num, line_num) of a page; words in the order they were recognised."""
    words = words.where(~is_blank(F.col("text")))
    return words.groupBy("doc_id", "page_number", "block_num", "line_num").agg(*_line([F.col("word_idx")], TESSERACT_DEFAULT, dpi))


def lines_by_gap(words: DataFrame, engine: str = "vision", dpi: int = 300) -> DataFrame:
    """Lines of a page's words whose tops follow each other closely: each is compared with the word before it."""
    gap, default = ENGINES[engine]
    order = Window.partitionBy("doc_id", "page_number").orderBy("top", "left", "word_idx")
    last = F.lag("top").over(order)
    new = F.when((last >= 0) & (F.abs(F.col("top") - last) > gap), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = words.where(~is_blank(F.col("text"))).withColumn("new", new).withColumn("line", F.sum("new").over(running))
    return numbered.groupBy("doc_id", "page_number", "line").agg(*_line([F.col("left"), F.col("top"), F.col("word_idx")], default, dpi))


def polygon_box(points: Column) -> Column:
    """The upright box around points (array<struct<x, y>>)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))


def font_categories(blocks: DataFrame) -> DataFrame:
    """Adds font_category to positioned blocks: heading, caption or body, by the document's own sizes.

    A size of exactly 12 is a default and is estimated from the box.  The thresholds are the sorted sizes at
    15 and 85 percent of their number; they come from a count of each size, not from all blocks in one list.
    """
    size = F.when(F.col("font_size") != 12.0, F.col("font_size")).otherwise((F.col("position.y1") - F.col("position.y0")) * 0.85)
    sized = blocks.where("position is not null").withColumn("inferred", size)
    counted = sized.groupBy("doc_id", "inferred").count()
    of_doc = Window.partitionBy("doc_id")
    up_to = of_doc.orderBy("inferred").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumns({"through": F.sum("count").over(up_to), "n": F.sum("count").over(of_doc)})
    at = lambda share: F.min(F.when(F.col("through") > F.floor(F.col("n") * share / 100), F.col("inferred")))
    limits = counted.groupBy("doc_id").agg(F.first("n").alias("n"), at(85).alias("heading"), at(15).alias("caption"), (F.max("inferred") - F.min("inferred")).alias("range"))
    category = (
        F.when((F.col("n") == 1) | (F.col("range") < 3.0), "body").when(F.col("inferred") >= F.col("heading"), "heading").when(F.col("inferred") <= F.col("caption"), "caption").otherwise("body")
    )
    return sized.join(limits, "doc_id").withColumn("font_category", category).drop("n", "heading", "caption", "range")


def large_enough(blocks: DataFrame) -> DataFrame:
    """Blocks with text and a box worth placing."""
    p = F.col("position")
    return blocks.where(~is_blank(F.col("raw_text")) & p.isNotNull() & (p["x1"] - p["x0"] >= LEAST_WIDTH) & (p["y1"] - p["y0"] >= LEAST_HEIGHT))


def overlap_pairs(blocks: DataFrame, many: int = MANY) -> DataFrame:
    """Blocks of a page whose boxes overlap in both directions, once each.

    Pages of up to ``many`` blocks compare all of them, larger ones those that are near each other.
    """
    page, p = ["doc_id", "page_number"], F.col("position")
    boxes = blocks.where(p.isNotNull()).select(*page, F.col("block_idx").alias("idx"), *[p[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    large = boxes.groupBy(*page).count().where(F.col("count") > many).select(*page)
    side = lambda n: boxes.join(large, page, "left_anti").select(*page, *[F.col(c).alias(f"{c}_{n}") for c in ("idx", "x0", "y0", "x1", "y1")])
    both = side("a").join(side("b"), page).where("idx_a < idx_b")
    meets = "NOT (x1_a < x0_b OR x0_a > x1_b) AND NOT (y1_a < y0_b OR y0_a > y1_b)"
    near = meeting_boxes(boxes.join(large, page, "left_semi"), page)
    return both.where(meets).select(*page, "idx_a", "idx_b").unionByName(near)


def _page_list(blocks: DataFrame, *more: str) -> DataFrame:
    p = F.col("position")
    item = F.struct(p["y0"].alias("y0"), p["x0"].alias("x0"), F.col("block_idx").alias("idx"), p["x1"].alias("x1"), (p["y1"] - p["y0"]).alias("h"), *more)
    return blocks.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _below(placed: Column, x: Column, y: Column, end: str, gap: float) -> Column:
    """y, or the end of what is placed over the same columns if that is lower."""
    met = F.filter(placed, lambda o: ~((x["x1"] < o["x0"]) | (x["x0"] > o["x1"])))
    return F.greatest(y, F.array_max(F.transform(met, lambda o: o[end] + gap)))


def resolve_overlaps(blocks: DataFrame, gap: float = 4.0, many: int = MANY) -> DataFrame:
    """doc_id, page_number, block_idx, adj_y0, adj_y1: each block below those before it that share its columns.

    From top to bottom, as each position depends on the moved ones: a fold over the blocks of a page, or a sweep
    that keeps the lowest end over every column for pages of more than ``many`` blocks whose boxes are in order.
    """
    none = F.expr("CAST(array() AS array<struct<idx:bigint,x0:double,x1:double,y0:double,end:double>>)")

    def step(placed: Column, x: Column) -> Column:
        y = _below(placed, x, x["y0"], "end", gap)
        return F.array_append(placed, F.struct(x["idx"].cast("long").alias("idx"), x["x0"].alias("x0"), x["x1"].alias("x1"), y.alias("y0"), (y + x["h"]).alias("end")))

    pages = _page_list(blocks)
    plain = F.forall("items", lambda x: F.coalesce((x["x0"] <= x["x1"]) & ~F.isnan(x["x1"]) & ~F.isnan(x["y0"]) & x["h"].isNotNull(), F.lit(False)))
    swept = (F.size("items") > many) & plain
    folded = pages.where(~swept).select("doc_id", "page_number", F.explode(F.aggregate("items", none, step)).alias("b"))
    moved = folded.select("doc_id", "page_number", "b.idx", "b.y0", "b.end").unionByName(sweep(pages.where(swept), gap))
    return moved.select("doc_id", "page_number", F.col("idx").alias("block_idx"), F.col("y0").alias("adj_y0"), F.col("end").alias("adj_y1"))


def place_lines(blocks: DataFrame, page_height: float = 842.0) -> DataFrame:
    """doc_id, page_number, block_idx, y (first baseline), n_lines (rendered), next_y: wrapped text pushed down.

    Text keeps one size, so it may be higher than its box; what would pass the page's end is left out.
    """
    p, line = F.col("position"), SIZE * 1.2
    lines = lines_to_width(F.col("raw_text"), p["x1"] - p["x0"] - 2 * PADDING, SIZE)
    none = F.expr("CAST(array() AS array<struct<idx:bigint,x0:double,x1:double,y:double,n:int,end:double>>)")

    def step(placed: Column, x: Column) -> Column:
        shown = F.filter(placed, lambda o: o["n"] > 0)
        y = _below(shown, x, x["y0"] + PADDING, "end", GAP) + SIZE
        n = F.least(x["lines"], F.greatest(F.lit(0), F.floor((F.lit(page_height - PADDING) - y) / line) + 1)).cast("int")
        return F.array_append(placed, F.struct(x["idx"].cast("long").alias("idx"), x["x0"].alias("x0"), x["x1"].alias("x1"), y.alias("y"), n.alias("n"), (y + n * line).alias("end")))

    moved = _page_list(blocks.withColumn("lines", lines), "lines").select("doc_id", "page_number", F.explode(F.aggregate("items", none, step)).alias("b"))
    return moved.select("doc_id", "page_number", F.col("b.idx").alias("block_idx"), F.col("b.y").alias("y"), F.col("b.n").alias("n_lines"), F.col("b.end").alias("next_y"))


def flow_pages(lines: DataFrame, size: float = 11.0, height: float = 842.0, margin: float = 50.0, numbered: bool = True) -> DataFrame:
    """Adds page_number and y to numbered lines (doc_id, line): a page holds what fits between its margins."""
    step = size * 1.4
    top = margin + (2 * step if numbered else 0.0)
    fits = 0
    while top + fits * step <= height - margin:
        fits += 1
    at = F.col("line")
    return lines.withColumns({"page_number": (F.floor(at / fits) + 1).cast("int"), "y": F.lit(top) + (at % fits) * step})
