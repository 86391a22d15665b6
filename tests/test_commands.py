import json

import pytest

from glyphflow.operators import backends, draw
from glyphflow.operators.translate import TranslationError
from glyphflow.plans import commands

BOX = "position struct<x0:double,y0:double,x1:double,y1:double>"


def blocks(spark):
    rows = [(1, 1, 0, "Hkkjr", "KrutiDev", 12.0, (0.0, 0.0, 100.0, 20.0)), (1, 2, 0, "ns'k", "KrutiDev", 80.0, (0.0, 5.0, 100.0, 30.0)), (2, 1, 0, "plain", "Arial", 9.0, None)]
    return spark.createDataFrame(rows, f"doc_id long, page_number int, block_idx int, raw_text string, font_name string, font_size double, {BOX}")


def test_translate_command(spark):
    got = {r.doc_id: r for r in commands.translate_command(blocks(spark)).collect()}
    assert got[1].translated_text == "--- Page 1 ---\n\n[TRANSLATED] भारत\n\n--- Page 2 ---\n\n[TRANSLATED] देश"
    assert (got[1].encoding, got[1].source_language, got[1].source_text) == ("kruti-dev", "hi", "भारत\n\nदेश")
    assert (got[2].encoding, got[2].source_language, got[2].translated_text) == ("unknown", "mr", "--- Page 1 ---\n\n[TRANSLATED] plain")


def test_convert_and_detect(spark):
    docs, pages = commands.detect_command(blocks(spark), "shusha")
    assert {r.encoding for r in docs.collect()} == {"shusha"} and {r.method for r in pages.collect()} == {"user_override"}
    assert [r.unicode_text for r in commands.convert_command(blocks(spark), recognised=True).where("doc_id = 1").orderBy("page_number").collect()] == ["Hkkjr", "ns'k"]
    assert {r.unicode_text for r in commands.convert_command(blocks(spark)).collect()} == {"भारत", "देश", "plain"}


def test_layouts(spark):
    got = sorted((r.page_number, r.y, r.size) for r in draw.in_place(blocks(spark)).collect())
    assert got == [(1, 12.0, 12.0), (2, 17.0, 12.0)]
    assert {(r.text, r.x) for r in draw.in_structure(blocks(spark)).collect()} == {("Hkkjr", 2.0), ("ns'k", 2.0)}
    pages = spark.createDataFrame([(1, 1, "word " * 200), (1, 2, "few")], "doc_id long, page_number int, page_text string")
    placed = draw.page_by_page(pages).collect()
    assert {r.size for r in placed if r.page_number == 2} == {11.0} and max(r.y for r in placed) <= 792
    texts = spark.createDataFrame([(1, "\n".join(["x"] * 100))], "doc_id long, text string")
    assert {r.page_number for r in draw.flowing(texts).collect()} == {1, 2, 3}


def test_backends():
    seen = []

    def fetch(answer, status=200):
        def run(method, url, headers, body):
            seen.append((method, url, body))
            return status, json.dumps(answer).encode()

        return run

    assert backends.google(fetch([[["a", "x"], ["b", "y"], None]])).call("t", "Marathi", "en") == "ab" and "sl=mr" in seen[-1][1]
    one = {"responseStatus": 200, "responseData": {"translatedText": "z"}}
    assert backends.mymemory(fetch(one)).call("t" * 1001, "mr", "en") == "zzz" and "mr-IN%7Cen-GB" in seen[-1][1]
    assert backends.ollama(fetch=fetch({"response": " r "})).call("t", "mr", "en") == "r"
    assert backends.openai("key", fetch=fetch({"choices": [{"message": {"content": "o"}}]})).call("t", "mr", "en") == "o"
    for bad in (backends.google(fetch([])), backends.google(fetch({}, 429)), backends.openai("k", fetch=fetch({"choices": []})), backends.mymemory(fetch({"responseStatus": 403})), backends.shell("/nonexistent/trans")):
        with pytest.raises(TranslationError):
            bad.call("t", "mr", "en")
    with pytest.raises(TranslationError):
        backends.gcp("p", used=500_000).call("t", "mr", "en")
    assert backends.create("mock", prefix=">").call("t", "mr", "en") == ">t"
    with pytest.raises(ValueError):
        backends.create("none")


def test_extract(spark):
    meta = spark.createDataFrame([(d, "f.pdf", "kruti-dev", 0.5, "hi", "en", "mock", 2, "now", None) for d in (1, 2)], "doc_id long, source_file string, encoding string, confidence double, source_language string, target_language string, backend string, page_count int, generated_at string, translated_text string")
    made = {r.doc_id: r.rendered for r in commands.extract_command(blocks(spark), meta).collect()}
    assert made[1].endswith("--- Page 1 ---\n\nभारत\n\n--- Page 2 ---\n\nदेश\n") and made[2].endswith("plain")
    raw = {r.doc_id: r.rendered for r in commands.extract_command(blocks(spark), meta, "markdown", raw=True).collect()}
    assert "## Page 2\n\nns'k" in raw[1]


def test_files_are_drawn_line_by_line(spark):
    """A stand-in for the writer: lines come in order of page and place, one document after the other."""
    rows = [(d, p, 10.0, y, 11.0, f"{d}{p}{y:.0f}") for d in (1, 2, None) for p in (3, 1) for y in (30.0, 5.0)]
    placed = spark.createDataFrame(rows, "doc_id long, page_number int, x double, y double, size double, text string").repartition(4)
    got = {r.doc_id: bytes(r.pdf).decode() for r in draw.pdf_files(placed, draw=lambda lines: ",".join(r["text"] for r in lines).encode()).collect()}
    assert got == {d: ",".join(f"{d}{p}{y}" for p in (1, 3) for y in (5, 30)) for d in (1, 2, None)}
