import random
import re

import pytest
from pyspark.sql import functions as F

from glyphflow.functions import shaping as S
from glyphflow.operators import layout, render


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def chunk_brute(text, size):
    if len(text) <= size:
        return [text]
    done, held = [], ""
    for p in text.split("\n\n"):
        if len(held) + len(p) + 2 <= size:
            held = held + "\n\n" + p if held else p
            continue
        done, held = done + [held] * bool(held), ""
        if len(p) <= size:
            held = p
            continue
        for s in re.findall(r"[^।॥.!?]*[।॥.!?]+\s*|[^।॥.!?]+$", p):
            if len(held) + len(s) <= size:
                held += s
            else:
                done, held = done + [held] * bool(held), s
    return done + [held] * bool(held)


def test_chunks_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["", "a" * 50, "a" * 51, "x. " * 40]
    for _ in range(60):
        texts.append("".join(rng.choice(["word ", "end. ", "\n\n", "क। ", "longer-word", "?! "]) for _ in range(rng.randrange(1, 60))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.chunks(F.col("t"), 50).alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: chunk_brute(t, 50) for i, t in enumerate(texts)}


def test_wrap(spark):
    assert one(spark, "aa bb cc\n\n dd", lambda c: S.wrap(c, 6)) == ["aa bb", "cc", "", "dd"]
    assert one(spark, "aaaa bbbb", lambda c: S.wrap_to_width(c, 20.0, 10.0)) == ["aaaa", "bbbb"]
    assert one(spark, "", lambda c: S.wrap(c, 6)) == [""]
    assert one(spark, "abcdefg", lambda c: S.slices(c, 3)) == ["abc", "def", "g"]


def test_sizes(spark):
    assert S.sizes_down(11.0, 6.0)[0] == 11.0 and len(S.sizes_down(11.0, 6.0)) == 6
    assert one(spark, "short", lambda c: S.fit_font_size(c, 300.0, 60.0)) == 11.0
    assert one(spark, "word " * 400, lambda c: S.fit_font_size(c, 300.0, 60.0)) == 6.0


@pytest.mark.parametrize(
    "text, want",
    [
        ("pre --- Page 2 ---\n two ---Page  1--- one", ["one", "two", ""]),
        ("pre --- Page 2 --- two", ["pre", "two", ""]),
        ("--- Page 1 ---a--- Page 1 ---b--- Page 9 ---c", ["b", "", ""]),
        ("a\nb\nc\nd", ["a", "b", "c\nd"]),
        ("a", ["a", "", ""]),
        ("", ["", "", ""]),
    ],
)
def test_page_markers(spark, text, want):
    assert one(spark, text, lambda c: S.pages_of_markers(c, 3)) == want


@pytest.mark.parametrize("share, want", [(0.0025, "0.2%"), (0.0075, "0.8%"), (0.95, "95.0%"), (1.0, "100.0%"), (0.8625, "86.2%"), (0.123, "12.3%")])
def test_percent(spark, share, want):
    assert spark.range(1).select(S.percent(F.lit(share))).first()[0] == want


def words(spark, tops):
    rows = [(1, 1, i, f"w{i}", float(10 * i), float(t), 5.0, 8.0, c, 0, 0) for i, (t, c) in enumerate(tops)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, word_idx int, text string, left double, top double, width double, height double, conf double, block_num int, line_num int")


def test_lines_chain_by_gap(spark):
    got = sorted((r.line, r.raw_text) for r in layout.lines_by_gap(words(spark, [(0, 90.0), (15, 80.0), (30, -1.0), (60, -1.0)])).collect())
    assert got == [(0, "w0 w1 w2"), (1, "w3")]
    conf = {r.line: r.confidence for r in layout.lines_by_gap(words(spark, [(0, 90.0), (15, 80.0), (60, -1.0)])).collect()}
    assert conf == {0: 0.85, 1: 0.9}
    line = layout.lines_by_number(words(spark, [(0, -1.0), (5, -1.0)])).first()
    assert (line.raw_text, line.confidence, line.x1) == ("w0 w1", 0.0, 15.0 * 0.24)


def test_pages_keep_their_words(spark):
    """The same places on two pages of a document are two lines."""
    both = words(spark, [(0, 90.0), (5, 80.0)])
    both = both.union(both.withColumn("page_number", F.lit(2)).withColumn("text", F.concat("text", F.lit("'"))))
    for lines in (layout.lines_by_gap(both), layout.lines_by_gap(both, "easy"), layout.lines_by_number(both)):
        assert sorted((r.page_number, r.raw_text) for r in lines.collect()) == [(1, "w0 w1"), (2, "w0' w1'")]


def boxes(spark, rows):
    return spark.createDataFrame([(1, 1, i, "some text", 12.0, b) for i, b in enumerate(rows)], "doc_id long, page_number int, block_idx int, raw_text string, font_size double, position struct<y0:double,x0:double,x1:double,y1:double>")


def test_overlaps_push_down(spark):
    df = boxes(spark, [(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 12.0), (8.0, 20.0, 30.0, 18.0), (9.0, 0.0, 25.0, 15.0)])
    assert [r.adj_y0 for r in layout.resolve_overlaps(df).orderBy("block_idx").collect()] == [0.0, 14.0, 8.0, 25.0]
    assert [(r.idx_a, r.idx_b) for r in layout.overlap_pairs(df).orderBy("idx_a", "idx_b").collect()] == [(0, 1), (0, 3), (1, 3), (2, 3)]
    placed = layout.place_lines(boxes(spark, [(0.0, 0.0, 100.0, 20.0), (5.0, 0.0, 100.0, 20.0), (835.0, 200.0, 300.0, 840.0)])).orderBy("block_idx").collect()
    assert placed[0].y == 13.0 and placed[1].y == placed[0].next_y + 8 + 11 and placed[2].n_lines == 0


def test_font_categories(spark):
    df = spark.createDataFrame([(1, i, float(i), (0.0, 0.0, 1.0, 1.0)) for i in range(1, 21) if i != 12] + [(1, 12, 12.0, (0.0, 0.0, 1.0, 12.0 / 0.85)), (2, 0, 9.0, (0.0, 0.0, 1.0, 1.0))], "doc_id long, block_idx int, font_size double, position struct<x0:double,y0:double,x1:double,y1:double>")
    got = {(r.doc_id, r.block_idx): r.font_category for r in layout.font_categories(df).collect()}
    assert {i for (d, i), c in got.items() if d == 1 and c == "heading"} == {18, 19, 20}
    assert {i for (d, i), c in got.items() if d == 1 and c == "caption"} == {1, 2, 3, 4}
    assert got[2, 0] == "body"


def test_renderings(spark):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (2, 1, "a|b\nc")], "doc_id long, page_number int, page_text string")
    meta = spark.createDataFrame([(d, "f.pdf", "kruti-dev", 0.95, "hi", "en", "mock", 2, "now", "TRANSLATED") for d in (1, 2)], "doc_id long, source_file string, encoding string, confidence double, source_language string, target_language string, backend string, page_count int, generated_at string, translated_text string")
    got = {r.doc_id: r.rendered for r in render.render(pages, meta).collect()}
    assert got[1].endswith("--- Page 1 ---\n\none\n\n--- Page 2 ---\n\ntwo\n") and "confidence: 95.0%" in got[1]
    assert got[2].endswith("=" * 60 + "\n\nTRANSLATED")
    assert {r.doc_id: r.rendered for r in render.render(pages, meta, use_translation=True).collect()}[1].endswith("TRANSLATED")
    assert "## Page 2" in {r.doc_id: r.rendered for r in render.render(pages, meta, "markdown").collect()}[1]
    texts = spark.createDataFrame([(1, "a|b\nc\n\nd", "x")], "doc_id long, source_text string, translated_text string")
    assert render.bilingual(texts, meta).first().rendered.endswith("| a\\|b c | x |\n| d |  |")
    assert one(spark, "a.b/c.pdf", lambda c: render.output_name(c, "_scanned.pdf")) == "a.b/c_scanned.pdf"


def test_line_counts_and_sizes_are_those_of_the_wrapped_lines(spark):
    """Sizes are found from the lengths of words alone; each must be what wrapping the text gives."""
    rng = random.Random(5)
    texts = ["", " ", "\n", "a", "x" * 200, "aa\n\nbb", "aaaa bbbb"] + [rng.choice([" ", "  ", "\n"]).join("w" * rng.choice([1, 2, 5, 9, 60]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = [(t, w, h) for t in texts for w, h in ((0.0, 20.0), (-1.0, 20.0), (60.0, 14.4), (150.0, 25.0), (300.0, 60.0))]
    df = spark.createDataFrame(rows, "t string, w double, h double")
    t, w, h = F.col("t"), F.col("w"), F.col("h")
    size = F.coalesce(*[F.when(F.size(S.wrap_to_width(t, w, s)) * F.lit(s * 1.2) <= h, F.lit(s)) for s in S.sizes_down(12.0, 5.0)], F.lit(5.0))
    page = F.coalesce(*[F.when(F.size(S.wrap(t, int(300.0 / (s * 0.5)))) * F.lit(s * 1.4) <= 60.0, F.lit(s)) for s in S.sizes_down(11.0, 6.0)], F.lit(6.0))
    found = df.select(S.fit_block_size(t, w, h, 12.0) == size, S.fit_font_size(t, 300.0, 60.0) == page, S.lines_to_width(t, w, 11.0) == F.size(S.wrap_to_width(t, w, 11.0)))
    assert all(all(r) for r in found.collect())


def test_sizes_do_not_wrap_the_text(spark):
    df = spark.createDataFrame([("a b", 9.0)], "t string, h double").select(S.fit_block_size(F.col("t"), F.lit(60.0), F.col("h"), 12.0).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # paragraphs, words: once for all sizes


def test_sentences_end_where_one_pattern_would_end_them(spark):
    rng = random.Random(8)
    texts = ["", " ", "a", ".", " . ", "a.  ", "a. .b", "  a!? b"] + ["".join(rng.choice("ab .!?\u0964\u00a0\n\u3000") for _ in range(rng.randrange(60))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.sentences(F.col("t")).alias("s")).collect()
    spaces, ends = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "\u0964\u0965.!?"
    assert all(r.s == re.findall(rf"[^{ends}]*[{ends}]+[{spaces}]*|[^{ends}]+\Z", r.t) for r in got)
