"""Recognised words from page images: an edge with pluggable engines, and what each engine is told."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import languages as L
from ..functions.text import is_blank

WORDS = "doc_id long, page_number int, word_idx int, text string, left double, top double, width double, height double, conf double, block_num int, line_num int, error string"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_WORDS = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in WORDS.split(", ")])
DPI = 300
#: Confidence of a page that is one block, without words' places, by engine.
WHOLE_PAGE = {"tesseract": 0.8, "vision": 0.9, "easyocr": 0.85}
Engine = Callable[[bytes, object], Iterator[dict]]


def language_for(engine: str, language: str):
    """What an engine is told for a language or its name."""
    key = language.lower()
    if engine == "tesseract":
        return L.OCR_TESSERACT.get(key, key)
    if engine == "vision":
        return L.OCR_VISION.get(key, [key])
    return L.OCR_EASY.get(key, ["en"])


def told(engine: str, language: Column) -> Column:
    """The same for a column of languages; several codes are joined by commas."""
    table = {"tesseract": L.OCR_TESSERACT, "vision": L.OCR_VISION, "easyocr": L.OCR_EASY}[engine]
    codes = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v if isinstance(v, str) else ",".join(v))])
    key = F.lower(language)
    return F.coalesce(codes[key], F.lit("en") if engine == "easyocr" else key)


def with_tesseract(image: bytes, language: object) -> Iterator[dict]:
    import io

    import pytesseract
    from PIL import Image

    data = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=language, output_type=pytesseract.Output.DICT)
    for i, text in enumerate(data["text"]):
        if text.strip():
            yield {"text": text} | {k: data[k][i] for k in ("left", "top", "width", "height", "conf", "block_num", "line_num")}


def box_of(points: list[tuple[float, float]]) -> dict:
    """The upright box around a polygon, as operators.layout.polygon_box has it."""
    xs, ys = [x for x, _ in points], [y for _, y in points]
    return {"left": min(xs), "top": min(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys)}


def text_with_tesseract(image: bytes, language: object) -> str:
    """A page's text without places."""
    import io

    import pytesseract
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(image)), lang=language)


_READERS: dict[str, object] = {}


def with_easyocr(image: bytes, language: object) -> Iterator[dict]:
    """A worker loads the model of a language once."""
    import easyocr

    key = ",".join(language)
    if key not in _READERS:
        _READERS[key] = easyocr.Reader(language)
    for points, text, conf in _READERS[key].readtext(image):
        if text.strip():
            yield {"text": text} | box_of([(p[0], p[1]) for p in points]) | {"conf": conf * 100, "block_num": 0, "line_num": 0}


def vision_words(pages: list) -> Iterator[dict]:
    """Words of an annotated page of the cloud service: symbols joined, a hundred words a block."""
    n = 0
    for page in pages:
        for block in page.blocks:
            for paragraph in block.paragraphs:
                for word in paragraph.words:
                    text = "".join(s.text for s in word.symbols)
                    if text.strip():
                        yield {"text": text} | box_of([(v.x, v.y) for v in word.bounding_box.vertices]) | {"conf": word.confidence * 100, "block_num": n // 100, "line_num": 0}
                        n += 1


def with_vision(image: bytes, language: object) -> Iterator[dict]:
    from google.cloud import vision

    answer = vision.ImageAnnotatorClient().document_text_detection(image=vision.Image(content=image), image_context={"language_hints": language})
    if answer.error.message:
        raise RuntimeError(answer.error.message)
    yield from vision_words(answer.full_text_annotation.pages)


ENGINES: dict[str, Engine] = {"tesseract": with_tesseract, "easyocr": with_easyocr, "vision": with_vision}
#: Of engines that can, the text of a page that has no words with places.
TEXTS: dict[str, Callable[[bytes, object], str]] = {"tesseract": text_with_tesseract}


def page_images(data: bytes, dpi: int = DPI) -> Iterator[tuple[int, bytes]]:
    """(page number, PNG) of a PDF's pages, where PyMuPDF is installed."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        for number, page in enumerate(document, 1):
            yield number, page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes("png")


def render_pages(files: DataFrame, render: Callable[[bytes], Iterator[tuple[int, bytes]]] = page_images) -> DataFrame:
    """doc_id, page_number, image, error of files (doc_id, content); a file that can't be rendered is a row with its error,
    after the pages that could be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):

                def row(number: int | None, image: bytes | None, error: str | None) -> pa.RecordBatch:
                    columns = [pa.array([doc], pa.int64()), pa.array([number], pa.int32()), pa.array([image], pa.binary()), pa.array([error], pa.string())]  # noqa: B023
                    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "page_number", "image", "error"])

                try:
                    for number, image in render(data):
                        yield row(number, image, None)
                except Exception as e:  # whatever a broken file makes the library raise
                    yield row(None, None, f"{type(e).__name__}: {e}")

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, page_number int, image binary, error string")


def whole_pages(pages: DataFrame, lines: DataFrame, engine: str) -> DataFrame:
    """One block for each page (doc_id, page_number, page_text) that has text but no line, in the engine's confidence."""
    alone = pages.join(lines.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti").where(~is_blank(F.col("page_text")))
    return alone.select("doc_id", "page_number", F.col("page_text").alias("raw_text"), F.lit(WHOLE_PAGE[engine]).alias("confidence"))


def recognise(images: DataFrame, engine: Engine | str, language: str = "mr", page_text: Callable[[bytes, object], str] | None = None) -> DataFrame:
    """Words of page images (doc_id, page_number, image); a page that fails is a row with its error.

    A page without words whose text can be had (page_text, or the engine's own) is one word, in the confidence of a
    whole page and without a place.
    """
    name = engine if isinstance(engine, str) else "custom"
    call = ENGINES[engine] if isinstance(engine, str) else engine
    if name == "tesseract":
        check_language(language, installed_languages())
    told, text_of = language_for(name, language), page_text or TEXTS.get(name)
    sure = WHOLE_PAGE.get(name, WHOLE_PAGE["tesseract"]) * 100

    def words(image: bytes) -> list[dict]:
        found = list(call(image, told))
        if not found and text_of and (text := text_of(image, told)).strip():
            found = [{"text": text.strip(), "conf": sure, "block_num": 0, "line_num": 0}]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, page, image in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page_number", "image")), strict=True):
                try:
                    rows = words(image)
                except Exception as e:  # whatever a broken image makes the engine raise
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                rows = [{"doc_id": doc, "page_number": page, "word_idx": i} | w for i, w in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _WORDS], schema=_WORDS)

    return images.where("image IS NOT NULL").select("doc_id", "page_number", "image").mapInArrow(run, WORDS)


class LanguageNotAvailable(ValueError):
    """The program lacks the data of a language."""


def installed_languages(ask: Callable[[], str] | None = None) -> set[str] | None:
    """The languages that the tesseract program has; None without the program.  ask: what it prints when asked for them."""
    if ask is None:
        program = shutil.which("tesseract")
        if program is None:
            return None

        def ask() -> str:
            return subprocess.run([program, "--list-langs"], capture_output=True, text=True, timeout=60).stdout

    lines = [line.strip() for line in ask().splitlines()]
    return {line for line in lines if line and not line.endswith(":") and " " not in line}


def check_language(language: str, installed: set[str] | None) -> None:
    """Refuses a language before any page is recognised; "mar+hin" needs both."""
    missing = [code for code in language_for("tesseract", language).split("+") if installed is not None and code not in installed]
    if missing:
        raise LanguageNotAvailable(f"tesseract has no data for {', '.join(missing)}; it has {', '.join(sorted(installed))}")


def gpu() -> str | None:
    """cuda or mps, whichever torch can use; None for neither."""
    if importlib.util.find_spec("torch") is None:
        return None
    import torch

    if torch.cuda.is_available():
        return "cuda"
    return "mps" if getattr(torch.backends, "mps", None) and torch.backends.mps.is_available() else None


def capabilities(spark: SparkSession, installed: set[str] | None = None) -> DataFrame:
    """engine, available, message, languages: what this driver could use, and tesseract's installed languages."""
    has = lambda m: importlib.util.find_spec(m) is not None
    installed = installed_languages() if installed is None else installed
    found, device = sorted(installed or ()), gpu()
    rows = [
        ("tesseract", has("pytesseract") and installed is not None, "needs pytesseract and the tesseract program", found),
        ("easyocr", has("easyocr"), "needs easyocr", sorted({two for _, two, _ in L.INDIAN})),
        ("vision", has("google.cloud.vision") if has("google") and has("google.cloud") else False, "needs google-cloud-vision and credentials", sorted({two for _, two, _ in L.INDIAN})),
        ("pymupdf", has("fitz"), "needs PyMuPDF", []),
        ("gpu", device is not None, device or "needs torch with CUDA or MPS", []),
    ]
    return spark.createDataFrame(rows, "engine string, available boolean, message string, languages array<string>")
