"""Scanned copies: every page becomes a picture, and the pictures a new file.

Sizes and pixels are columns; rendering and writing are edges with pluggable functions, by PyMuPDF where it is
installed.  A document is one file, so its pictures come to one task, page after page: that task holds the file it
writes and a batch of pictures, never all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import OVER, threshold
from ..sources.ocr import DPI, page_images, render_pages

#: How a page is kept, and the quality of its picture.
MODES, QUALITY = ("color", "grayscale", "bw"), 85
Assemble = Callable[[Iterable[bytes]], bytes]


def picture_size(width: Column, height: Column, dpi: int = DPI) -> Column:
    """struct<zoom, width, height> of a page's picture in pixels; sizes are in points, pixels are rounded up."""
    zoom = dpi / 72
    return F.struct(F.lit(zoom).alias("zoom"), F.ceil(width * zoom).cast("int").alias("width"), F.ceil(height * zoom).cast("int").alias("height"))


def in_mode(pixels: Column, mode: str) -> Column:
    """Grey values as the mode keeps them."""
    check_options(mode)
    return threshold(pixels) if mode == "bw" else pixels


def check_options(mode: str = "color", dpi: int = DPI, quality: int = QUALITY) -> None:
    """Mistakes that a plan can find before any file is read."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    if dpi <= 0 or not 1 <= quality <= 100:
        raise ValueError("dpi must be above 0, and quality between 1 and 100")


def pictures(mode: str = "color", dpi: int = DPI, quality: int = QUALITY) -> Callable[[bytes], Iterator[tuple[int, bytes]]]:
    """Pages as JPEG in color or grey, or as PNG in black and white, where PyMuPDF is installed."""
    check_options(mode, dpi, quality)
    black_or_white = bytes(255 if grey > OVER else 0 for grey in range(256))

    def render(data: bytes) -> Iterator[tuple[int, bytes]]:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as document:
            for number, page in enumerate(document, 1):
                picture = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), colorspace=fitz.csRGB if mode == "color" else fitz.csGRAY, alpha=False)
                if mode == "bw":
                    yield number, fitz.Pixmap(fitz.csGRAY, picture.width, picture.height, picture.samples.translate(black_or_white), False).tobytes("png")
                else:
                    yield number, picture.tobytes("jpeg", jpg_quality=quality)

    return render


def assembled(pictures: Iterable[bytes]) -> bytes:
    """A PDF of one picture a page."""
    import fitz

    document = fitz.open()
    for data in pictures:
        picture = fitz.open(stream=data, filetype="png" if data[:4] == b"\x89PNG" else "jpeg")
        area = picture[0].rect
        document.new_page(width=area.width, height=area.height).insert_image(area, stream=data)
    return document.tobytes()


def in_turn(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Each key of sorted batches with its rows, which are there one at a time."""
    rows = (row for batch in batches for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist())
    return groupby(rows, lambda row: row[key])


def scan_copy(files: DataFrame, render: Callable[[bytes], Iterator[tuple[int, bytes]]] = page_images, assemble: Assemble = assembled) -> DataFrame:
    """doc_id, pdf, error of files (doc_id, content); a file of which a page can't be rendered has no copy, and its error."""
    schema = pa.schema([("doc_id", pa.int64()), ("pdf", pa.binary()), ("error", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, pages in in_turn(batches, "doc_id"):
            first = next(pages)  # an error has no page number and comes first
            pdf = None if first["error"] else assemble(p["image"] for p in (one for part in ([first], pages) for one in part))
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "pdf": pdf, "error": first["error"]}], schema)

    ordered = render_pages(files, render).repartition("doc_id").sortWithinPartitions("doc_id", F.col("page_number").asc_nulls_first())
    return ordered.mapInArrow(join, "doc_id long, pdf binary, error string")
