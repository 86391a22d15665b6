"""Texts of pages and documents, and the text, Markdown and bilingual renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import percent


def _ordered(order: list[str], text: Column, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def text_of(unicode_text: Column, raw: Column) -> Column:
    """A block's text: the converted one if there is any, even empty."""
    return F.coalesce(unicode_text, raw)


def display_text(translated: Column, unicode_text: Column, raw: Column) -> Column:
    """A block's text as shown: the first that is not empty."""
    return F.coalesce(F.nullif(translated, F.lit("")), F.nullif(unicode_text, F.lit("")), raw)


def page_texts(blocks: DataFrame, text: str = "raw_text") -> DataFrame:
    return blocks.groupBy("doc_id", "page_number").agg(_ordered(["block_idx"], F.col(text), "\n").alias("page_text"), F.count(F.lit(1)).alias("n_blocks"))


def document_texts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(_ordered(["page_number"], F.col("page_text"), "\n\n").alias("doc_text"), F.count(F.lit(1)).alias("page_count"))


def fonts_used(blocks: DataFrame) -> DataFrame:
    """Distinct names of fonts, by document."""
    return blocks.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.nullif("font_name", F.lit("")))).alias("fonts"))


#: Header fields, as columns of the rows that are rendered.
FIELDS = ("source_file", "encoding", "confidence", "source_language", "target_language", "backend", "page_count", "generated_at")


TITLE = "Translation Output"


def text_header(title: str = TITLE) -> Column:
    """The header above a rule of 60 signs; generated_at is a column, so that reruns agree."""
    c = F.col
    lines = [
        F.lit(title),
        F.lit("=" * len(title)),
        F.concat(F.lit("Source File: "), c("source_file")),
        F.concat(F.lit("Encoding: "), c("encoding"), F.lit(" (confidence: "), percent(c("confidence")), F.lit(")")),
        F.concat(F.lit("Languages: "), c("source_language"), F.lit(" → "), c("target_language")),
        F.concat(F.lit("Backend: "), c("backend")),
        F.concat(F.lit("Pages: "), c("page_count").cast("string")),
        F.concat(F.lit("Generated: "), c("generated_at")),
    ]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("=" * 60), F.lit(""))


def markdown_header() -> Column:
    c = F.col
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    lines = [
        F.concat(F.lit("# Translation: "), c("source_file")),
        F.lit(""),
        F.lit("| Property | Value |"),
        F.lit("|----------|-------|"),
        row("Source File", F.concat(F.lit("`"), c("source_file"), F.lit("`"))),
        row("Encoding", c("encoding")),
        row("Confidence", percent(c("confidence"))),
        row("Languages", F.concat(c("source_language"), F.lit(" → "), c("target_language"))),
        row("Backend", c("backend")),
        row("Pages", c("page_count").cast("string")),
        row("Generated", c("generated_at")),
    ]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("---"), F.lit(""))


def _paged(pages: DataFrame, before: str, after: str) -> Column:
    block = F.concat(F.lit(before), F.col("page_number").cast("string"), F.lit(after + "\n\n"), F.coalesce("page_text", F.lit("")), F.lit("\n"))
    return _ordered(["page_number"], block, "\n")


def render(pages: DataFrame, meta: DataFrame, kind: str = "text", use_translation: bool = False) -> DataFrame:
    """doc_id and rendered: header, then the document, with marked pages if it has several.

    pages: doc_id, page_number, page_text; meta: doc_id, the header's FIELDS, and translated_text (may be
    null).  Documents of several pages show their own text unless use_translation is set.
    """
    before, after, header = ("--- Page ", " ---", text_header()) if kind == "text" else ("## Page ", "", markdown_header())
    body = pages.groupBy("doc_id").agg(_paged(pages, before, after).alias("paged"), _ordered(["page_number"], F.col("page_text"), "\n\n").alias("plain"), F.count(F.lit(1)).alias("n"))
    single = F.coalesce(F.col("translated_text"), F.col("plain"))
    several = (F.col("n") > 1) & (F.lit(not use_translation) | F.col("translated_text").isNull())
    content = F.when(several, F.col("paged")).otherwise(single)
    return body.join(meta, "doc_id").select("doc_id", F.concat_ws("\n", header, content).alias("rendered"))


def bilingual_rows(texts: DataFrame) -> DataFrame:
    """doc_id, ord, original, translation: paragraphs side by side; the shorter side is padded.

    texts: doc_id, source_text, translated_text.  Bars are escaped and line breaks flattened for a table.
    """
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    zipped = F.arrays_zip(F.split("source_text", "\n\n").alias("s"), F.split("translated_text", "\n\n").alias("t"))
    rows = texts.select("doc_id", F.posexplode(zipped).alias("ord", "p"))
    return rows.select("doc_id", "ord", cell(F.col("p.s")).alias("original"), cell(F.col("p.t")).alias("translation"))


def bilingual(texts: DataFrame, meta: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), F.col("original"), F.lit(" | "), F.col("translation"), F.lit(" |"))
    table = bilingual_rows(texts).groupBy("doc_id").agg(_ordered(["ord"], line, "\n").alias("table"))
    head = F.concat_ws("\n", markdown_header(), F.lit("## Bilingual Content"), F.lit(""), F.lit("| Original | Translation |"), F.lit("|----------|-------------|"))
    return table.join(meta, "doc_id").select("doc_id", F.concat_ws("\n", head, F.col("table")).alias("rendered"))


def output_name(name: Column, suffix: str) -> Column:
    """A file's name with another ending, such as _converted.txt."""
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(suffix))
