import json

import pytest

from glyphflow.sources import mappings, ocr, pdf


def test_mapping_files(spark, tmp_path):
    (tmp_path / "my-font.json").write_text(json.dumps({"mappings": {"a": "अ", "b": "ब"}, "ligatures": {"ab": "क", "a": "आ"}}), encoding="utf-8")
    got = [(r.legacy, r.unicode) for r in mappings.load(spark, "My_Font", [str(tmp_path)]).orderBy("ord").collect()]
    assert got == [("ab", "क"), ("a", "आ"), ("b", "ब")]
    assert mappings.load(spark, "kruti-dev", [str(tmp_path)]).count() == 81 and mappings.load(spark, "none", [str(tmp_path)]).count() == 0
    assert mappings.available(spark, [str(tmp_path), str(tmp_path / "none")]) == ["my-font"]
    assert mappings.load(spark, "MY FONT", [f"file://{tmp_path}/none", f"file://{tmp_path}/"]).count() == 3
    (tmp_path / "odd.json").write_text('{"mappings": [1]}')
    (tmp_path / "cut.json").write_text("{")
    (tmp_path / "notes.txt").write_text("no table")
    tables = {}
    for r in mappings.read_tables(spark, str(tmp_path)).orderBy("encoding", "ord").collect():
        tables.setdefault(r.encoding, []).append((r.legacy, r.unicode) if r.error is None else r.error.partition(":")[0])
    assert tables == {"my-font": [("ab", "क"), ("a", "आ"), ("b", "ब")], "odd": ["TypeError"], "cut": ["MappingError"]}
    with pytest.raises(mappings.MappingError):
        mappings.parse("{}", ".json")
    with pytest.raises(mappings.MappingError):
        mappings.parse("{", ".json")


def test_pdf_edge(spark, tmp_path):
    for name, data in (("a.pdf", b"ok"), ("b.PDF", b"broken"), ("c.txt", b"ok")):
        (tmp_path / name).write_bytes(data)

    def extract(data):
        if data != b"ok":
            raise ValueError("no PDF")
        base = {"page_number": 1, "width": 10.0, "height": 20.0, "block_no": 0}
        spans = [(0, 0, " ", "F0", 9.0, 0), (0, 1, "ab\x00", "F1", 10.0, 1), (0, 2, "c", "F2", 11.0, 2), (1, 0, "  ", "F3", 9.0, 0)]
        for line, i, text, font, size, x in spans:
            yield base | {"line_no": line, "span_idx": i, "text": text, "font": font, "size": size, "x0": float(x), "y0": 0.0, "x1": x + 1.0, "y1": 5.0}

    spans = pdf.read_spans(spark, str(tmp_path), extract).cache()
    assert sorted(r.error for r in spans.where("error is not null").collect()) == ["ValueError: no PDF"]
    blocks = pdf.blocks_of_spans(spans).collect()
    assert [(b.raw_text, b.font_name, b.font_size, b.position.x0, b.position.x1) for b in blocks] == [(" abc", "F1", 10.0, 1.0, 3.0)]
    assert isinstance(pdf.available()[0], bool)


def test_fonts_and_metadata(spark):
    raw = spark.createDataFrame([(1, 1, 0, "ABC+X", "n", "TrueType", 5, "e"), (1, 2, 0, "ABC+X", "n", "TrueType", 7, "e"), (1, 1, 1, "", "", "Type1", 3, None)], "doc_id long, page_number int, ord int, basefont string, name string, type string, xref int, encoding string")
    got = [(r.name, r.is_embedded, r.is_subset) for r in pdf.fonts_of(raw).orderBy("place").collect()]
    assert got == [("ABC+X", True, True), ("Unknown", False, False)]
    info = spark.createDataFrame([("", "x", 3)], "title string, author string, page_count int")
    assert pdf.metadata_of(info).first().asDict() == {"title": None, "author": "x", "page_count": 3}


def test_ocr_edge(spark):
    images = spark.createDataFrame([(1, 1, b"a b")], "doc_id long, page_number int, image binary")

    def engine(image, language):
        for i, w in enumerate(image.decode().split()):
            yield {"text": w, "left": i * 10.0, "top": 0.0, "width": 5.0, "height": 5.0, "conf": 90.0, "block_num": 0, "line_num": 0}

    assert [r.text for r in ocr.recognise(images, engine).orderBy("word_idx").collect()] == ["a", "b"]
    assert ocr.language_for("tesseract", "Marathi") == "mar" and ocr.language_for("vision", "mar") == ["mr", "hi"] and ocr.language_for("easyocr", "zz") == ["en"]
    listed = {r.engine: r for r in ocr.capabilities(spark, {"mar", "eng"}).collect()}
    assert len(listed) == 5 and listed["tesseract"].languages == ["eng", "mar"] and "hi" in listed["vision"].languages


def test_languages_are_refused_before_any_work():
    installed = ocr.installed_languages(lambda: 'List of available languages in "/usr/share/" (3):\neng\nmar\nosd\n')
    assert installed == {"eng", "mar", "osd"}
    ocr.check_language("Marathi", installed)
    ocr.check_language("hi", None)  # unknown here: workers may have it
    with pytest.raises(ocr.LanguageNotAvailable, match="no data for hin; it has eng, mar, osd"):
        ocr.check_language("devanagari", installed)


def test_codes_of_recognisers():
    """The two tables made of one list, against plain ones."""
    assert {k: ocr.L.OCR_VISION[k] for k in ("marathi", "mr", "mar", "hindi", "tam", "te", "kannada", "malayalam", "bn", "guj", "punjabi", "devanagari")} == {
        "marathi": ["mr", "hi"], "mr": ["mr", "hi"], "mar": ["mr", "hi"], "hindi": ["hi"], "tam": ["ta"], "te": ["te"], "kannada": ["kn"], "malayalam": ["ml"], "bn": ["bn"], "guj": ["gu"], "punjabi": ["pa"], "devanagari": ["mr", "hi", "sa"],
    }
    assert len(ocr.L.OCR_VISION) == 28 and len(ocr.L.OCR_EASY) == 31
    assert (ocr.L.OCR_EASY["mar"], ocr.L.OCR_EASY["devanagari"], ocr.L.OCR_EASY["eng"]) == (["mr", "en"], ["hi", "mr", "en"], ["en"])


def test_small_tables_of_few_files_are_dealt_out(spark, tmp_path, monkeypatch):
    from glyphflow.sources import tables

    rows = spark.range(1000).selectExpr("id", "uuid() AS u", "repeat(uuid(), 50) AS t").coalesce(1)
    rows.write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(tables, "LEAST", 1)
    got = tables.read(spark, str(tmp_path), "t")
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and got.count() == 1000
    monkeypatch.setattr(tables, "SMALL", 1)
    assert tables.read(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1
