"""Whole jobs: the commands and service pipelines, as compositions of operators.

Each takes blocks (doc_id, page_number, block_idx, raw_text, and where known font_name, font_size, position)
and returns tables; reading files and writing results is left to sources and sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, convert, detect, render, scan, translate, usage
from ..operators.render import output_name


def detect_command(blocks: DataFrame, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) with their encodings; encoding: the user's own choice for all."""
    pages = detect.override(blocks.select("doc_id", "page_number").distinct(), encoding) if encoding else detect.detect_pages(blocks)
    return detect.detect_documents(pages, blocks.select("doc_id").distinct()), pages


def convert_command(blocks: DataFrame, encoding: str | None = None, recognised: bool = False) -> DataFrame:
    """Blocks with unicode_text; recognised text is Unicode already."""
    if recognised:
        return blocks.withColumns({"unicode_text": F.col("raw_text"), "encoding_used": F.lit("unicode-ocr"), "success": F.lit(True)})
    _, pages = detect_command(blocks, encoding)
    return convert.warnings(convert.convert_blocks(blocks, pages))


def translate_command(blocks: DataFrame, backend: translate.Backend | None = None, encoding: str | None = None, target: str = "en", recognised: bool = False) -> DataFrame:
    """doc_id, encoding, source_language, source_text, translated_text, chunk_count, warnings: page by page, with markers."""
    documents, _ = detect_command(blocks, "unicode-ocr" if recognised else encoding)
    converted = convert_command(blocks, encoding, recognised)
    texts = render.page_texts(converted, "unicode_text")
    keyed = texts.select(F.struct("doc_id", "page_number").alias("doc_id"), F.col("page_text").alias("source_text"))
    done = translate.translate_texts(keyed, backend, target=target).select("doc_id.*", F.col("translated_text").alias("page_text"), "chunk_count", "warnings")
    marked = translate.page_marked(done)
    counts = done.groupBy("doc_id").agg(F.sum("chunk_count").alias("chunk_count"), F.flatten(F.collect_list("warnings")).alias("warnings"))
    source = render.document_texts(texts).select("doc_id", F.col("doc_text").alias("source_text"))
    named = documents.select("doc_id", "encoding", "confidence", catalog.source_language(F.col("encoding")).alias("source_language"))
    return named.join(source, "doc_id").join(marked, "doc_id").join(counts, "doc_id").withColumnRenamed("marked", "translated_text")


def extract_command(blocks: DataFrame, meta: DataFrame, kind: str = "text", encoding: str | None = None, raw: bool = False) -> DataFrame:
    """doc_id and rendered: text or Markdown of the documents, converted unless raw."""
    converted = blocks.withColumn("unicode_text", F.col("raw_text")) if raw else convert_command(blocks, encoding)
    return render.render(render.page_texts(converted, "unicode_text"), meta, kind)


def scan_copy_command(files: DataFrame, mode: str = "color", dpi: int = scan.DPI, quality: int = scan.QUALITY, render=None, assemble=scan.assembled) -> DataFrame:
    """name and pdf of files (doc_id, name, content): each page a picture; render and assemble default to PyMuPDF."""
    scan.check_options(mode, dpi, quality)
    copies = scan.scan_copy(files, render or scan.pictures(mode, dpi, quality), assemble)
    return copies.join(files.select("doc_id", output_name(F.col("name"), "_scanned.pdf").alias("name")), "doc_id").select("name", "pdf")


def usage_command(events: DataFrame) -> DataFrame:
    """The current month of each service, with what is left of the free characters."""
    return usage.limit_report(usage.current_usage(events))
