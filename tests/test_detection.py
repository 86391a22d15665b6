import pytest
from pyspark.sql import functions as F

from glyphflow.functions import detection as D
from glyphflow.operators import detect

LEGACY = "´ÖÆüÖ¸üÖÂ™Òü ¸üÖ•Ö³ÖÖÂÖÖ †×¬Ö×®ÖμÖ´Ö"
HINDI = "Hkkjr ns'k esa d`fr gS fd dh"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "name, encoding",
    [("Shree-Dev-0714", "shree-dev"), ("ShreeDev0714", "shree-dev"), ("SHREE_DEV_0702", "shree-dev"), ("shree dev 0705", "shree-dev"), ("Shree-Lipi", "shree-lipi"), ("SDL-Dev", "shree-lipi")]
    + [(n, "kruti-dev") for n in ("KrutiDev", "Kruti-Dev", "KRUTI_DEV", "Kruti Dev 010", "krutidev040", "AkrutiDev")]
    + [(n, "unicode-devanagari") for n in ("Mangal", "Nirmala UI", "Kokila", "Sakal Marathi", "Shruti")]
    + [("Paragraph", "agra"), ("Walkman-Chanakya", "walkman-chanakya"), ("Chanakya", "chanakya")],
)
def test_font_names(spark, name, encoding):
    assert one(spark, name, D.of_font).encoding == encoding


@pytest.mark.parametrize("name", ["Arial", "Times New Roman", "Helvetica", "", None])
def test_other_fonts(spark, name):
    assert one(spark, name, D.of_font) is None


def test_custom_patterns_go_first(spark):
    assert one(spark, "Kruti Dev Mine", lambda c: D.of_font(c, [("mine", ["mine$"])])).encoding == "mine"


@pytest.mark.parametrize("text, is_it", [("Hello महाराष्ट्र World", True), ("Test: भारत", True), ("2024 में हिंदी", True), (LEGACY, False), (HINDI, False), ("", False), (None, False), (" \n\t", False)])
def test_unicode(spark, text, is_it):
    assert one(spark, text, D.is_unicode_text) is is_it


@pytest.mark.parametrize(
    "text, encoding, confidence, fallbacks",
    [
        (LEGACY, "shree-lipi", 0.90, ["dvb-tt"]),
        (HINDI, "kruti-dev", 0.8625, ["chanakya"]),
        ("Plain English text with no special markers", "unknown", 0.0, []),
        ("", "unknown", 0.0, []),
        (None, "unknown", 0.0, []),
        ("éééé abc àààà", "unknown-legacy", 0.5, ["shree-dev", "shree-lipi", "kruti-dev"]),
    ],
)
def test_texts(spark, text, encoding, confidence, fallbacks):
    got = one(spark, text, D.of_text)
    assert (got.encoding, round(got.confidence, 12), got.fallbacks) == (encoding, confidence, fallbacks)


def test_displaced_bests_become_fallbacks(spark):
    scores = F.array(*[F.struct(F.lit(e).alias("encoding"), F.lit(s).alias("score")) for e, s in (("a", 0.2), ("b", 0.5), ("c", 0.4))])
    got = spark.range(1).select(D.best_signature(scores).alias("x")).first().x
    assert (got.best, got.fallbacks) == ("b", ["a", "c"])


def test_flags(spark):
    rows = spark.createDataFrame([(e,) for e in ("Unicode", "utf8", "unknown", "unicode-ocr", "unknown-legacy", "shusha")], "e string")
    got = [(r[0], r[1]) for r in rows.select(D.is_unicode(F.col("e")), D.is_legacy(F.col("e"))).collect()]
    assert got == [(True, False), (True, False), (False, False), (False, True), (False, True), (False, True)]


def blocks(spark):
    rows = [(1, p, i, t, f) for p, i, t, f in ((1, 0, "x", "Mangal"), (1, 1, "y", None), (2, 0, "z", "Shree-Dev-0714"), (3, 0, "plain", None))]
    rows += [(2, p, 0, "t", f) for p, f in ((1, "Shusha"), (2, "Chanakya"), (3, "Chanakya"), (4, "Shusha"))] + [(3, 1, 0, "plain", "Arial")]
    return spark.createDataFrame(rows, "doc_id long, page_number int, block_idx int, raw_text string, font_name string")


def test_pages_and_documents(spark):
    pages = detect.detect_pages(blocks(spark))
    got = {(r.doc_id, r.page_number): r.encoding for r in pages.collect()}
    assert got == {(1, 1): "unicode-devanagari", (1, 2): "shree-dev", (2, 1): "shusha", (2, 2): "chanakya", (2, 3): "chanakya", (2, 4): "shusha"}
    docs = {r.doc_id: r for r in detect.detect_documents(pages, blocks(spark).select("doc_id").distinct()).collect()}
    assert (docs[2].encoding, docs[2].fallbacks, docs[2].n_pages, docs[2].method) == ("shusha", ["chanakya"], 4, "font_match")
    assert (docs[3].encoding, docs[3].confidence, docs[3].n_pages) == ("unknown", 0.0, 0)
    assert docs[1].confidence == round((1.0 + 0.95) / 2, 12)


def test_document_fonts_decide_for_all_pages(spark):
    fonts = spark.createDataFrame([(1, 0, "Arial"), (1, 1, "KrutiDev"), (2, 0, "Mangal"), (2, 1, "KrutiDev")], "doc_id long, ord int, name string")
    got = {(r.doc_id, r.page_number): r.encoding for r in detect.detect_pages(blocks(spark), fonts).collect()}
    assert {e for (d, _), e in got.items() if d == 1} == {"kruti-dev"} and got[2, 1] == "shusha"
