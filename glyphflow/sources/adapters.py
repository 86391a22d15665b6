"""Documents, blocks and words out of plain tables, for corpora that come without page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_A_PAGE = 20
#: Pages of a document of recognised words.
PAGES_OF = 8
#: Font names that stand in for those of a page, dealt out by document.
FONTS = [None, "Shree-Dev-0714", "KrutiDev010", "Arial", "Mangal", "DVBWTTSurekhNormal", "Paragraph", "AkrutiDev", "Chanakya", "Times New Roman", "APS-C-DV", "Shusha", "SDL-Dev", ""]


def blocks(documents: DataFrame, fonts: bool = False) -> DataFrame:
    """One row for each line: doc_id, page_number, block_idx, raw_text, font_size, position, and font_name."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "raw_text"))
    d, i = F.col("doc_id"), F.col("block_idx")
    x0 = (50 + (d + i) % 3 * 150).cast("double")
    y0 = (40 + i % LINES_A_PAGE * 14 + (d * 5 + i * 3) % 7).cast("double")
    right = x0 + F.least(F.length("raw_text") * 5, F.lit(300)).cast("double")
    size = (8 + (d * 7 + i) % 12).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), right.alias("x1"), (y0 + 6 + (d * 3 + i * 5) % 20).alias("y1"))
    out = lines.select("doc_id", (1 + F.floor(i / LINES_A_PAGE)).cast("int").alias("page_number"), "block_idx", "raw_text", size.alias("font_size"), box.alias("position"))
    if not fonts:
        return out
    names = F.array(*[F.lit(f).cast("string") for f in FONTS])
    return out.withColumn("font_name", F.element_at(names, (d % len(FONTS) + 1).cast("int")))


#: The same blocks in SQL, for comparison.
BLOCKS_SQL = f"""
  SELECT doc_id, 1 + block_idx // {LINES_A_PAGE} AS page_number, block_idx, raw_text, CAST(8 + (doc_id * 7 + block_idx) % 12 AS DOUBLE) AS font_size,
    CAST(50 + (doc_id + block_idx) % 3 * 150 AS DOUBLE) AS x0,
    CAST(40 + block_idx % {LINES_A_PAGE} * 14 + (doc_id * 5 + block_idx * 3) % 7 AS DOUBLE) AS y0,
    CAST(50 + (doc_id + block_idx) % 3 * 150 AS DOUBLE) + least(length(raw_text) * 5, 300) AS x1,
    CAST(40 + block_idx % {LINES_A_PAGE} * 14 + (doc_id * 5 + block_idx * 3) % 7 AS DOUBLE) + 6 + (doc_id * 3 + block_idx * 5) % 20 AS y1,
    [{", ".join("NULL" if f is None else f"'{f}'" for f in FONTS)}][doc_id % {len(FONTS)} + 1] AS font_name
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_text, unnest(range(len(string_split(text, chr(10))))) AS block_idx FROM documents)
"""


def ocr_words(lineitem: DataFrame) -> DataFrame:
    """Rows of numbers as recognised words, an order being a page and eight of them a document: doc_id, page_number,
    word_idx, text, box in pixels, conf, block_num, line_num."""
    return lineitem.select(
        F.floor(F.col("l_orderkey") / PAGES_OF).alias("doc_id"),
        (F.col("l_orderkey") % PAGES_OF + 1).cast("int").alias("page_number"),
        F.col("l_linenumber").alias("word_idx"),
        F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
        (F.col("l_partkey") % 500).cast("double").alias("left"),
        (F.floor("l_quantity") * 10).cast("double").alias("top"),
        (20 + F.col("l_suppkey") % 50).cast("double").alias("width"),
        (10 + F.col("l_suppkey") % 9).cast("double").alias("height"),
        (F.round(F.col("l_discount") * 1000) - 5).alias("conf"),
        (F.col("l_linenumber") % 3).alias("block_num"),
        (F.col("l_suppkey") % 4).alias("line_num"),
    )


WORDS_SQL = f"""
  SELECT l_orderkey // {PAGES_OF} AS doc_id, CAST(l_orderkey % {PAGES_OF} + 1 AS INT) AS page_number, l_linenumber AS word_idx, 'w' || l_partkey AS text, CAST(l_partkey % 500 AS DOUBLE) AS "left", CAST(floor(l_quantity) * 10 AS DOUBLE) AS top,
    CAST(20 + l_suppkey % 50 AS DOUBLE) AS width, CAST(10 + l_suppkey % 9 AS DOUBLE) AS height, round(l_discount * 1000) - 5 AS conf, l_linenumber % 3 AS block_num, l_suppkey % 4 AS line_num
  FROM lineitem
"""


def usage_events(events: DataFrame) -> DataFrame:
    """Events as uses of a service: service, characters, ts."""
    return events.select(F.col("event_type").alias("service"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("characters"), "ts", "user_id")
