"""Conversion of blocks to Unicode, each in its own encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data.encodings import PARTS
from ..functions import conversion as C
from ..functions.detection import UNICODE_NAMES


def convert_blocks(blocks: DataFrame, page_encodings: DataFrame | None = None, encoding: str | None = None) -> DataFrame:
    """Adds encoding_used, unicode_text, success, unmapped, confidence to blocks (raw_text, detected_encoding).

    encoding overrides page_encodings (doc_id, page_number, encoding), which overrides the block's own.  The
    tables are literals in one branch for each encoding, so nothing is shuffled for them.
    """
    own = F.col("detected_encoding") if "detected_encoding" in blocks.columns else F.lit(None).cast("string")
    if encoding is not None:
        blocks = blocks.withColumn("encoding_used", F.lit(encoding))
    elif page_encodings is not None:
        named = page_encodings.select("doc_id", "page_number", F.col("encoding").alias("page_encoding"))
        blocks = blocks.join(named, ["doc_id", "page_number"], "left").withColumn("encoding_used", F.coalesce("page_encoding", own)).drop("page_encoding")
    else:
        blocks = blocks.withColumn("encoding_used", own)
    raw, used = F.col("raw_text"), F.col("encoding_used")
    none = F.array().cast("array<string>")
    made = F.struct(raw.alias("converted"), none.alias("unmapped"))
    for e in PARTS:
        made = F.when(used == e, C.applied(raw, e)).otherwise(made)
    known = F.coalesce(used.isin(*PARTS), F.lit(False))
    out = blocks.withColumn("made", C.composed(made))
    success = F.coalesce(known | F.lower(used).isin(*UNICODE_NAMES) | used.isNull(), F.lit(True))
    out = out.withColumns({"unicode_text": F.col("made.converted"), "unmapped": F.col("made.unmapped"), "success": success}).drop("made")
    return out.withColumn("confidence", C.conversion_rate(raw, F.size("unmapped")))


def warnings(blocks: DataFrame) -> DataFrame:
    """Adds warnings: the missing table, or the count and the first five of the unmapped characters."""
    shown = F.array_join(F.transform(F.slice("unmapped", 1, 5), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    none = F.array().cast("array<string>")
    missing = F.array(F.concat(F.lit("No mapping table available for "), F.col("encoding_used")))
    found = F.array(F.concat(F.lit("Found "), F.size("unmapped").cast("string"), F.lit(" unmapped character(s): "), shown))
    return blocks.withColumn("warnings", F.when(~F.col("success"), missing).when(F.size("unmapped") > 0, found).otherwise(none))
