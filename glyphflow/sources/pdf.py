"""PDF documents as tables: files to spans, spans to blocks, fonts and metadata.

Files are read by Spark (binaryFile), so any store will do; the text layer of a file is extracted in an Arrow
function, one file at a time, by PyMuPDF where it is installed or by any function of the same shape.  All
that follows from spans is expressed on DataFrames and needs no PDF library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank

SPANS = "path string, page_number int, width double, height double, block_no int, line_no int, span_idx int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, error string"
#: A dict for each span, or one with an error.
Extractor = Callable[[bytes], Iterator[dict]]


def available() -> tuple[bool, str]:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return False, "PyMuPDF is not installed"
    return True, "PyMuPDF"


def opened(data: bytes, password: str | None = None):
    """The document, unlocked if it is locked; a wrong password is an error."""
    import fitz

    document = fitz.open(stream=data, filetype="pdf")
    if document.needs_pass and not document.authenticate(password or ""):
        document.close()
        raise ValueError("the document is locked by a password")
    return document


def info_of(data: bytes, password: str | None = None) -> Iterator[dict]:
    """The info dictionary, and the number of pages."""
    with opened(data, password) as document:
        yield {k: (document.metadata or {}).get(k) for k in ("title", "author", "subject", "creator", "producer", "creationDate", "modDate")} | {"page_count": document.page_count}


def font_rows(data: bytes, password: str | None = None) -> Iterator[dict]:
    """The fonts of every page, as fonts_of takes them."""
    with opened(data, password) as document:
        for number, page in enumerate(document, 1):
            for i, (xref, _, kind, base, name, encoding, *_) in enumerate(page.get_fonts(full=True)):
                yield {"page_number": number, "ord": i, "basefont": base, "name": name, "type": kind, "xref": xref, "encoding": encoding}


def spans_of(page) -> Iterator[dict]:
    """Spans of the text layer of one page."""
    for b, block in enumerate(x for x in page.get_text("dict")["blocks"] if x["type"] == 0):
        for n, line in enumerate(block["lines"]):
            for i, span in enumerate(line["spans"]):
                x0, y0, x1, y1 = span["bbox"]
                yield {"width": page.rect.width, "height": page.rect.height, "block_no": b, "line_no": n, "span_idx": i, "text": span["text"], "font": span["font"], "size": span["size"], "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def with_pymupdf(data: bytes, password: str | None = None) -> Iterator[dict]:
    """Spans of the text layer, page by page."""
    with opened(data, password) as document:
        for number, page in enumerate(document, 1):
            yield from ({"page_number": number} | span for span in spans_of(page))


INFO = "path string, title string, author string, subject string, creator string, producer string, creationDate string, modDate string, page_count int, error string"
FONT_ROWS = "path string, page_number int, ord int, basefont string, name string, type string, xref int, encoding string, error string"


def read_metadata(spark: SparkSession, path: str, extract: Extractor = info_of, password: str | None = None) -> DataFrame:
    """A row of metadata for every PDF under a path; empty fields are null."""
    return metadata_of(read_rows(spark, path, extract, INFO, password))


def read_fonts(spark: SparkSession, path: str, extract: Extractor = font_rows, password: str | None = None) -> DataFrame:
    """Distinct fonts of every PDF under a path, which is their doc_id."""
    return fonts_of(read_rows(spark, path, extract, FONT_ROWS, password).where("error is null").withColumnRenamed("path", "doc_id"))


def read_spans(spark: SparkSession, path: str, extract: Extractor = with_pymupdf, password: str | None = None) -> DataFrame:
    """Spans of every PDF under a path; a file that can't be read is a row with its error."""
    return read_rows(spark, path, extract, SPANS, password)


def read_rows(spark: SparkSession, path: str, extract: Extractor, ddl: str, password: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    names = [f.split()[0] for f in ddl.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in ddl.split(", ")])
    key = {} if password is None else {"password": password}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = [{"path": name} | s for s in extract(data, **key)]
                except Exception as e:  # whatever a broken file makes the library raise
                    rows = [{"path": name, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


#: Characters that a span may not have: controls other than line ends and tabs, and the replacement character.
DIRT = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]"
#: What text of legacy fonts may have: line ends, tabs, and one-byte characters.
ONE_BYTE = r"[^\n\r\t\x20-\x7E\x{80}-\x{FF}]"


def clean_legacy(text):
    return F.regexp_replace(text, ONE_BYTE, "")


def without_dirt(text):
    return F.regexp_replace(text, DIRT, "")


def blocks_of_spans(spans: DataFrame) -> DataFrame:
    """One block for each line with text: its spans' text, font and size of the first that has some, and box."""
    cleaned = spans.where("error IS NULL").withColumn("text", without_dirt(F.col("text")))
    full = ~is_blank(F.col("text"))
    line = ["path", "page_number", "block_no", "line_no"]
    parts = F.array_sort(F.collect_list(F.struct("span_idx", "text")))
    first = lambda c: F.min_by(c, F.when(full, F.col("span_idx")))
    box = F.struct(*[f(F.when(full, F.col(c))).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    made = cleaned.groupBy(*line).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("raw_text"), first("font").alias("font_name"), first("size").alias("font_size"), box.alias("position"))
    return made.where(~is_blank(F.col("raw_text")))


def fonts_of(raw: DataFrame) -> DataFrame:
    """Distinct fonts of a document in the order met: raw (doc_id, page_number, ord, basefont, name, type, xref, encoding)."""
    name = F.coalesce(F.nullif("basefont", F.lit("")), F.nullif("name", F.lit("")), F.lit("Unknown"))
    embedded = (F.col("xref") > 0) & ~F.coalesce(F.col("type").isin("Type1", "Type3"), F.lit(False))
    named = raw.select("doc_id", F.struct("page_number", "ord").alias("place"), name.alias("name"), "encoding", embedded.alias("is_embedded"))
    once = named.groupBy("doc_id", "name", "encoding", "is_embedded").agg(F.min("place").alias("place"))
    return once.withColumn("is_subset", F.col("name").contains("+"))


def metadata_of(info: DataFrame) -> DataFrame:
    """Empty fields of the info dictionary are null; dates stay text."""
    return info.select(*[F.nullif(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in info.dtypes])
