"""Edges with stand-ins, and the operators around conversion against DuckDB."""

import os
from types import SimpleNamespace as Of

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphflow.data import encodings
from glyphflow.operators import backends, layout, scan, sessions
from glyphflow.operators import translate as T
from glyphflow.plans import commands, services
from glyphflow.sources import files as table_files
from glyphflow.sources import ocr, pdf

SMALL = "/root/testdata/sf0.001"


def _same(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert len(rows) > 0
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", services.NAMES)
def test_queries_match_their_sql(spark, name):
    _same(spark, name)


def test_locked_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"locked")

    def extract(data, password=None):
        if password != "open":
            raise ValueError("the document is locked by a password")
        yield {"page_number": 1, "text": "t", "block_no": 0, "line_no": 0, "span_idx": 0}

    assert [r.error for r in pdf.read_spans(spark, str(tmp_path), extract).collect()] == ["ValueError: the document is locked by a password"]
    assert [r.text for r in pdf.read_spans(spark, str(tmp_path), extract, "open").collect()] == ["t"]


def test_metadata_and_fonts_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    info = pdf.read_metadata(spark, str(tmp_path), lambda data: iter([{"title": "", "author": "A", "page_count": 2}])).first()
    assert (info.title, info.author, info.page_count) == (None, "A", 2)
    rows = [{"page_number": 1, "ord": i, "basefont": b, "name": "n", "type": "TrueType", "xref": 4, "encoding": None} for i, b in enumerate(["X+F", "X+F", "G"])]
    assert sorted((r.name, r.is_subset) for r in pdf.read_fonts(spark, str(tmp_path), lambda data: iter(rows)).collect()) == [("G", False), ("X+F", True)]


def test_pictures_of_pages(spark):
    files = spark.createDataFrame([(1, b"ab"), (2, b"!"), (3, b"c")], "doc_id long, content binary")

    def render(data):
        if data == b"!":
            raise ValueError("broken")
        yield from ((n, bytes([x])) for n, x in reversed(list(enumerate(data, 1))))

    copies = {r.doc_id: (r.pdf and bytes(r.pdf), r.error) for r in scan.scan_copy(files, render, b"|".join).collect()}
    assert copies == {1: (b"a|b", None), 2: (None, "ValueError: broken"), 3: (b"c", None)}
    with pytest.raises(ValueError):
        scan.in_mode(None, "sepia")


def test_scan_copy_command(spark):
    files = spark.createDataFrame([(1, "a/b.pdf", b"ab")], "doc_id long, name string, content binary")
    pages = lambda data: iter([(2, data[1:]), (1, data[:1])])
    assert [(r.name, bytes(r.pdf)) for r in commands.scan_copy_command(files, "bw", render=pages, assemble=b"+".join).collect()] == [("a/b_scanned.pdf", b"a+b")]
    for wrong in ({"mode": "sepia"}, {"dpi": 0}, {"quality": 101}):
        with pytest.raises(ValueError):
            commands.scan_copy_command(files, **wrong)


def test_a_file_for_each_document(spark, tmp_path):
    table_files.write_each(spark.createDataFrame([("x.txt", "one\ntwo"), ("y.txt", "three")], "name string, rendered string"), str(tmp_path / "out"))
    found = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("name=*/part-*.txt")}
    assert found == {"name=x.txt": "one\ntwo\n", "name=y.txt": "three\n"}


def one_page(data):
    """A file whose second page can't be rendered."""
    yield 1, b"i"
    raise ValueError("page 2")


def test_engines(spark):
    def engine(image, language):
        if image == b"!":
            raise RuntimeError("broken")
        yield {"text": "w", "left": 0.0, "top": 0.0, "width": 1.0, "height": 1.0, "conf": 50.0, "block_num": 0, "line_num": 0}

    images = spark.createDataFrame([(1, 1, b"!"), (1, 2, b"x")], "doc_id long, page_number int, image binary")
    assert [(r.page_number, r.text, r.error) for r in ocr.recognise(images, engine).collect()] == [(1, None, "RuntimeError: broken"), (2, "w", None)]
    none = lambda image, language: iter([])
    whole = ocr.recognise(images, none, page_text=lambda image, language: " a page \n" if image == b"x" else " ")
    assert [(r.page_number, r.text, r.conf, r.left) for r in whole.collect()] == [(2, "a page", 80.0, None)]
    assert [(r.page_number, r.raw_text, r.confidence) for r in layout.lines_by_number(whole).collect()] == [(2, "a page", 0.8)]
    failed = ocr.render_pages(spark.createDataFrame([(7, b"x")], "doc_id long, content binary"), one_page)
    assert [(r.page_number, r.image and bytes(r.image), r.error) for r in failed.collect()] == [(1, b"i", None), (None, None, "ValueError: page 2")]
    assert ocr.recognise(failed, engine).count() == 1
    assert set(ocr.ENGINES) == {"tesseract", "easyocr", "vision"}


def test_words_of_the_cloud_service():
    corner = lambda x, y: Of(x=x, y=y)
    word = lambda t: Of(symbols=[Of(text=c) for c in t], bounding_box=Of(vertices=[corner(1, 2), corner(5, 2), corner(5, 9), corner(1, 9)]), confidence=0.5)
    page = Of(blocks=[Of(paragraphs=[Of(words=[word("ab"), word(" ")] + [word("c")] * 100)])])
    rows = list(ocr.vision_words([page]))
    assert rows[0] == {"text": "ab", "left": 1, "top": 2, "width": 4, "height": 7, "conf": 50.0, "block_num": 0, "line_num": 0}
    assert len(rows) == 101 and rows[-1]["block_num"] == 1


def test_no_call_beyond_the_limit(spark):
    backend = backends.create("gcp_cloud", project="p", used=T.FREE_TIER)
    with pytest.raises(T.UsageLimitExceeded):
        backend.call("x", "mr", "en")
    texts = spark.createDataFrame([(1, "text")], "doc_id long, source_text string")
    with pytest.raises(Exception, match="characters are used"):
        T.translate_texts(texts, backend).collect()


def test_growing_waits():
    assert [T.timeout_of(a) for a in range(5)] == [60.0, 90.0, 135.0, 180.0, 180.0]
    slept = []

    def call(text, source, target):
        raise T.TranslationError("no")

    import pyarrow as pa

    backend = T.Backend("b", call, retries=4, backoff=3.0, sleep=slept.append)
    batch = pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array(["c"])], names=["key", "chunk"])
    assert [b.column("error").to_pylist() for b in T._edge(backend, "mr", "en")(iter([batch]))] == [["no"]]
    assert [int(s // 3) for s in slept] == [1, 2, 4]


def test_threads_keep_one_pace():
    import pyarrow as pa

    inside, most = [], []

    def sleep(_):
        inside.append(1)
        most.append(len(inside))
        inside.pop()

    backend = T.Backend("b", lambda t, s, d: t, pace=T.Pace(0.0, sleep=sleep))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(30)]), pa.array(["c"] * 30)], names=["key", "chunk"])
    assert sum(b.num_rows for b in T._edge(backend, "mr", "en")(iter([batch]))) == 30
    assert max(most) == 1 and backend.pace.sent == 30


def test_block_keys_tell_nulls_apart(spark):
    blocks = spark.createDataFrame([(1, None, 2, "a"), (1, 2, None, "b")], "doc_id long, page_number int, block_idx int, raw_text string")
    assert sorted(r.translated_text for r in T.translate_blocks(blocks).collect()) == ["[TRANSLATED] a", "[TRANSLATED] b"]


def test_sessions(spark):
    rows = [("a", 1, "create", None), ("a", 2, "set_result", "x"), ("b", 1, "create", None), ("b", 2, "delete", None), ("c", 1, "set_result", "y"), ("d", 1, "set_result", "old"), ("d", 2, "create", None)]
    got = sessions.store(spark.createDataFrame(rows, "session_id string, at long, kind string, result string"))
    assert sorted((r.session_id, r.result) for r in got.collect()) == [("a", "x"), ("d", None)]


def test_tables_have_their_keys():
    """Sizes of the fixed glyph tables, so that none loses or gains a key unseen."""
    assert {e: len(encodings.glyphs(e)) for e in encodings.PARTS} == SIZES


SIZES = {"shree-lipi": 77, "kruti-dev": 81, "dvb-tt": 137, "shree-dev": 220, "chanakya": 119, "aps-dv": 133, "walkman-chanakya": 115, "shusha": 138}


def test_what_is_asked_is_what_the_query_shows(spark):
    """Language models get the tested instruction, and colours go by the tested pattern."""
    import json

    asked = []

    def fetch(method, url, headers, body):
        asked.append(json.loads(body))
        return 200, json.dumps({"response": "r", "choices": [{"message": {"content": "o"}}]}).encode()

    backends.ollama(fetch=fetch).call("text", "mr", "en")
    backends.openai("k", fetch=fetch).call("text", "mr", "en")
    shown = spark.range(1).select(T.prompt(F.lit("text"), "Marathi", "English")).first()[0]
    assert asked[0]["prompt"] == shown and asked[1]["messages"][0]["content"] + "\n\ntext" == shown


def test_colours_of_a_program(tmp_path):
    program = tmp_path / "trans"
    program.write_text("#!/bin/sh\nprintf '\\033[1mbold\\033[0m text\\n'\n")
    program.chmod(0o755)
    assert backends.shell(str(program)).call("x", "mr", "en") == "bold text"


def test_boxes_of_polygons(spark):
    points = [(3.0, 9.0), (1.0, 4.0), (8.0, 5.0)]
    column = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
    assert spark.range(1).select(layout.polygon_box(column).alias("b")).first().b.asDict() == ocr.box_of(points)
