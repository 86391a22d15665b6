import pytest

from glyphflow.operators import translate as T
from glyphflow.operators import usage as U
from glyphflow.sources import files


def texts(spark):
    return spark.createDataFrame([(1, "one. two."), (2, "  "), (3, "bad"), (4, "one. two."), (5, "x" * 30 + ". " + "y" * 30)], "doc_id long, source_text string")


def test_mock(spark):
    got = {r.doc_id: (r.translated_text, r.chunk_count) for r in T.translate_texts(texts(spark), size=40).collect()}
    assert got[1] == ("[TRANSLATED] one. two.", 1) and got[2] == ("  ", 1)
    assert got[5] == ("[TRANSLATED] " + "x" * 30 + ". \n\n[TRANSLATED] " + "y" * 30, 2)


def test_backend_failures_keep_the_source(spark):
    from glyphflow.operators.translate import TranslationError

    def call(text, source, target):
        if text == "bad":
            raise TranslationError("no")
        return text.upper()

    got = {r.doc_id: r for r in T.translate_texts(texts(spark), T.Backend("upper", call, retries=2), size=40).collect()}
    assert got[1].translated_text == got[4].translated_text == "ONE. TWO."
    assert got[3].translated_text == "bad" and got[3].warnings == ["Chunk 1 translation failed: no"] and got[1].warnings == []
    assert got[5].translated_text == "X" * 30 + ". \n\n" + "Y" * 30


def test_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "text"), (1, 1, 1, " ")], "doc_id long, page_number int, block_idx int, raw_text string")
    assert [r.translated_text for r in T.translate_blocks(blocks).orderBy("block_idx").collect()] == ["[TRANSLATED] text", None]


def test_guard(spark):
    assert T.guard(texts(spark), 0, 1000) == 85
    with pytest.raises(T.UsageLimitExceeded):
        T.guard(texts(spark), 999_999, 1_000_000)


def test_pace():
    slept = []
    pace = T.Pace(2.0, sleep=slept.append)
    for _ in range(12):
        pace.wait()
    assert all(1.0 <= s <= 4.0 for s in slept[:5]) and all(1.5 <= s <= 6.0 for s in slept[5:10]) and all(2.25 <= s <= 9.0 for s in slept[10:])


def test_usage(spark):
    events = spark.createDataFrame([("gcp", 490_000, "2024-01-05 00:00:00"), ("gcp", 5, "2024-02-01 00:00:00"), ("x", 1, "2024-01-31 23:59:59")], "service string, characters long, ts string").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    monthly = U.monthly_usage(events)
    assert {(r.service, r.month): r.characters for r in monthly.collect()} == {("gcp", "2024-01"): 490_000, ("gcp", "2024-02"): 5, ("x", "2024-01"): 1}
    assert {(r.service, r.month) for r in U.current_usage(events).collect()} == {("gcp", "2024-02"), ("x", "2024-01")}
    requests = spark.createDataFrame([("gcp", "2024-01", 10_000), ("gcp", "2024-01", 10_001), ("new", "2024-01", 500_001)], "service string, month string, n long")
    assert sorted((r.n, r.exceeds) for r in U.check_limit(requests, monthly).collect()) == [(10_000, False), (10_001, True), (500_001, True)]
    report = {r.service: (r.percent_used, r.remaining) for r in U.limit_report(U.current_usage(events)).collect()}
    assert report["gcp"] == (0.001, 499_995)


def test_sessions_and_uploads(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", False), ("b", "2024-01-01 00:00:00", True), ("c", "2024-01-01 00:30:00", False)], "session_id string, created_at string, processing boolean").selectExpr("session_id", "cast(created_at as timestamp) as created_at", "processing")
    assert [r.session_id for r in U.expired_sessions(rows, "2024-01-01 00:30:01").collect()] == ["a"]
    up = spark.createDataFrame([("a.PDF", 1), ("a.pdf", 0), ("a.txt", 1), ("b.pdf", 50_000_001)], "name string, length long")
    assert [r.status for r in U.valid_uploads(up).collect()] == [200, 400, 400, 413]


def test_usage_files(spark):
    text = '{"gcp": {"2024-01": {"characters": 7, "last_updated": "2024-01-02T03:04:05"}}, "x": {}}'
    rows = files.usage_of_json(spark.createDataFrame([(text,), ("broken {",)], "json string"))
    assert [(r.service, r.month, r.characters) for r in rows.collect()] == [("gcp", "2024-01", 7)]
    assert '"characters":7' in files.usage_json(rows).first().json


def test_texts_are_cut_once_and_only_what_is_asked_for_is_collected(spark):
    long = "a. " * 900 + "b"
    given = spark.createDataFrame([(1, long), (2, " "), (3, None), (4, "short")], "doc_id long, source_text string")
    done = T.translate_texts(given, T.Backend("odd", lambda t, a, b: None if t == "short" else t.upper()))
    got = {r.doc_id: (r.translated_text.replace("\n\n", ""), r.chunk_count, r.warnings) for r in done.collect()}
    assert got == {1: (long.upper(), 2, []), 2: (" ", 1, []), 3: ("", 1, []), 4: ("short", 1, [])}
    plan = T.characters_sent(given, done)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "size(parts" not in plan and "size(CASE" not in plan
