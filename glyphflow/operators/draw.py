"""What a PDF writer is to draw, as a relation; and the writer itself, where PyMuPDF is installed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import fit_font_size, sizes_down, wrap, wrap_to_width
from ..functions.text import is_blank
from . import layout
from .scan import in_turn

#: doc_id, page_number, x, y, size, text: one line of text each.
PLACED = ("doc_id", "page_number", "x", "y", "size", "text")
A4 = (595.0, 842.0)


def in_place(blocks: DataFrame) -> DataFrame:
    """Blocks at their own places and sizes; a size out of 4 to 72 becomes 12."""
    size = F.when(F.col("font_size").between(4, 72), F.col("font_size")).otherwise(F.lit(12.0))
    shown = blocks.where(F.col("position").isNotNull() & ~is_blank(F.col("raw_text")))
    return shown.select("doc_id", "page_number", F.col("position.x0").alias("x"), (F.col("position.y0") + size).alias("y"), size.alias("size"), F.col("raw_text").alias("text"))


def in_structure(blocks: DataFrame, page_height: float = 842.0) -> DataFrame:
    """Translated blocks at one size, wrapped to their boxes, moved below what they would cover."""
    kept = layout.large_enough(blocks)
    moved = layout.resolve_overlaps(kept, layout.GAP)
    p = F.col("position")
    kept = kept.join(moved, ["doc_id", "page_number", "block_idx"]).withColumn("position", F.struct(p["x0"].alias("x0"), F.col("adj_y0").alias("y0"), p["x1"].alias("x1"), F.col("adj_y1").alias("y1")))
    placed = layout.place_lines(kept, page_height)
    width = F.col("position.x1") - F.col("position.x0") - 2 * layout.PADDING
    lines = kept.select("doc_id", "page_number", "block_idx", F.col("position.x0").alias("x0"), F.posexplode(wrap_to_width(F.col("raw_text"), width, layout.SIZE)).alias("n", "text"))
    shown = lines.join(placed, ["doc_id", "page_number", "block_idx"]).where("n < n_lines")
    return shown.select("doc_id", "page_number", (F.col("x0") + layout.PADDING).alias("x"), (F.col("y") + F.col("n") * layout.SIZE * 1.2).alias("y"), F.lit(layout.SIZE).alias("size"), "text")


def page_by_page(pages: DataFrame, width: float = A4[0], height: float = A4[1], margin: float = 50.0) -> DataFrame:
    """Each page's text at the largest size at which it fits; what still does not is cut at the page's end."""
    size = fit_font_size(F.col("page_text"), width, height, margin)
    sized = pages.withColumn("size", size)
    lines = F.coalesce(*[F.when(F.col("size") == s, wrap(F.col("page_text"), int((width - 2 * margin) / (s * 0.5)))) for s in [*sizes_down(11.0, 6.0), 6.0]])
    shown = sized.select("doc_id", "page_number", "size", F.posexplode(lines).alias("n", "text"))
    shown = shown.withColumns({"x": F.lit(margin), "y": margin + F.col("size") + F.col("n") * F.col("size") * 1.4})
    return shown.where(F.col("y") <= height - margin).select(*PLACED)


def flowing(texts: DataFrame) -> DataFrame:
    """A whole text (doc_id, text) wrapped at 80 characters over as many pages as it takes."""
    lines = texts.select("doc_id", F.posexplode(wrap(F.col("text"), 80)).alias("line", "text"))
    return layout.flow_pages(lines).select("doc_id", "page_number", F.lit(50.0).alias("x"), "y", F.lit(11.0).alias("size"), "text")


def any_placed(blocks: DataFrame) -> DataFrame:
    """doc_id and whether any of its blocks is both translated and positioned, which its layout depends on."""
    shown = F.col("translated_text").isNotNull() & (F.col("translated_text") != "") & F.col("position").isNotNull()
    return blocks.groupBy("doc_id").agg(F.bool_or(shown).alias("placed"))


def choose(blocks: DataFrame, pages: DataFrame, preserve: bool = True, structure: bool = False) -> DataFrame:
    """The layout that the options ask for."""
    return in_structure(blocks) if structure else in_place(blocks) if preserve else page_by_page(pages)


def drawn(lines: Iterator[dict], font_file: str | None = None) -> bytes:
    """A PDF of a document's placed lines, which come page by page; a page without any is empty."""
    import fitz

    document, page = fitz.open(), None
    for r in lines:
        while document.page_count < r["page_number"]:
            page = document.new_page(width=A4[0], height=A4[1])
        page.insert_text((r["x"], r["y"]), r["text"], fontsize=r["size"], fontfile=font_file, fontname="own" if font_file else "helv")
    return document.tobytes()


def pdf_files(placed: DataFrame, font_file: str | None = None, draw: Callable[[Iterator[dict]], bytes] | None = None) -> DataFrame:
    """doc_id and pdf: a document is one file, so its lines come to one task, in order of page and place; draw defaults
    to PyMuPDF."""
    write = draw or (lambda lines: drawn(lines, font_file))
    schema = pa.schema([("doc_id", pa.int64()), ("pdf", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, lines in in_turn(batches, "doc_id"):
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "pdf": write(lines)}], schema)

    ordered = placed.select(*PLACED).repartition("doc_id").sortWithinPartitions("doc_id", "page_number", "y", "x")
    return ordered.mapInArrow(run, "doc_id long, pdf binary")
