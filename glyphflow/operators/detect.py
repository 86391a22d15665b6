"""Encodings of blocks, pages and documents.

Blocks are judged row by row.  A page takes its most confident block (the first among equals, none below
confidence 0), a document its most frequent page encoding (the one met first among equals).  Both steps are
aggregations that combine before the shuffle, with the order carried in the compared values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detection as D


def detect_blocks(blocks: DataFrame) -> DataFrame:
    """Adds found: struct(encoding, confidence, method, fallbacks)."""
    font = F.col("font_name") if "font_name" in blocks.columns else F.lit(None).cast("string")
    return blocks.withColumn("found", D.of_block(font, F.col("raw_text")))


def detect_pages(blocks: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, encoding, confidence, method; pages without any evidence are absent.

    fonts (doc_id, ord, name): if a document's first recognised font is a legacy one, that is the verdict for
    all its pages, and their texts are not judged.
    """
    key = F.struct(F.col("found.confidence").alias("c"), (-F.col("block_idx")).alias("i"))
    best = lambda df: df.groupBy("doc_id", "page_number").agg(F.max_by(F.struct("found.encoding", "found.confidence", "found.method"), key).alias("b")).where("b.confidence > 0").select("doc_id", "page_number", "b.*")
    if fonts is None:
        return best(detect_blocks(blocks))
    shortcut = first_font_match(fonts).where(D.is_legacy(F.col("encoding"))).select("doc_id", "encoding", "confidence", "method")
    rest = blocks.join(shortcut.select("doc_id"), "doc_id", "left_anti")
    copied = blocks.select("doc_id", "page_number").distinct().join(shortcut, "doc_id").select("doc_id", "page_number", "encoding", "confidence", "method")
    return best(detect_blocks(rest)).union(copied)


def first_font_match(fonts: DataFrame) -> DataFrame:
    """doc_id and the verdict of the first font, by ord, that is recognised at all."""
    judged = fonts.withColumn("found", D.of_font(F.col("name"))).where("found is not null")
    return judged.groupBy("doc_id").agg(F.min_by("found", "ord").alias("f")).select("doc_id", "f.encoding", "f.confidence", "f.method")


def detect_documents(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, encoding, confidence (mean of all judged pages), method, fallbacks (ranks two to four), n_pages.

    documents: adds a row 'unknown' for those without any judged page.
    """
    kinds = pages.groupBy("doc_id", "encoding").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first"), F.min_by("method", "page_number").alias("method"), F.sum("confidence").alias("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "encoding", "method", "n", "total")))
    out = kinds.groupBy("doc_id").agg(ranked.alias("r"))
    total = lambda f: F.aggregate(F.transform("r", lambda x: x[f].cast("double")), F.lit(0.0), lambda a, b: a + b)
    n_pages = F.aggregate(F.transform("r", lambda x: x["n"]), F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.select(
        "doc_id",
        F.col("r")[0]["encoding"].alias("encoding"),
        F.round(total("total") / total("n"), 12).alias("confidence"),
        F.col("r")[0]["method"].alias("method"),
        F.transform(F.slice("r", 2, 3), lambda x: x["encoding"]).alias("fallbacks"),
        n_pages.alias("n_pages"),
    )
    if documents is None:
        return out
    every = documents.select("doc_id").join(out, "doc_id", "left")
    none = F.array().cast("array<string>")
    defaults: dict[str, Column] = {"encoding": F.lit("unknown"), "confidence": F.lit(0.0), "method": F.lit("heuristic"), "fallbacks": none, "n_pages": F.lit(0).cast("long")}
    return every.select("doc_id", *[F.coalesce(c, d).alias(c) for c, d in defaults.items()])


def override(pages: DataFrame, encoding: str) -> DataFrame:
    """The user's own choice, for every page."""
    return pages.select("doc_id", "page_number", F.lit(encoding).alias("encoding"), F.lit(1.0).alias("confidence"), F.lit("user_override").alias("method"))


def ocr_result(pages: DataFrame) -> DataFrame:
    """What recognised text counts as: Unicode already."""
    return override(pages, "unicode-ocr").withColumn("method", F.lit("unicode_detected"))


def report(pages: DataFrame) -> DataFrame:
    """Page verdicts in page order, numbered by document."""
    order = Window.partitionBy("doc_id").orderBy("page_number")
    return pages.withColumn("ord", F.row_number().over(order))
