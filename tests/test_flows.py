"""Running sums, budgets, rates and the queries over files and streams."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import translate as T
from glyphflow.operators import usage as U
from glyphflow.operators.running import running_sums
from glyphflow.plans import flows

from .test_services import SMALL, _same


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["paged_documents", "document_files", "session_states", "budget_cut", "send_times", "custom_patterns"])
def test_queries_match_their_sql(spark, name):
    assert name in dir(flows)
    _same(spark, name)


def test_running_sums_of_hot_null_and_small_groups(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [(None, i, 1) for i in range(50)] + [("one", 5, None), ("two", None, 3), ("two", 1, 4)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(5)
    got = {(r.g, r.k): (r.n, r.before, r.rows) for r in running_sums(df.withColumn("one", F.lit(1)), ["g"], ["k"], {"before": "n", "rows": "one"}).collect()}
    expected, state = {}, {}
    for g, k, n in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        total, seen = state.get(g, (0, 0))
        expected[g, k] = (n, total, seen)
        state[g] = (total + (n or 0), seen + 1)
    assert got == expected


def test_running_sums_split_a_hot_group(spark):
    """No task has a third of a group's rows."""
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("k"), F.lit(1).alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        summed = running_sums(df, ["g"], ["k"], {"before": "n"})
        assert summed.where("before <> k").count() == 0 and summed.count() == 20_000
        ranged = df.repartitionByRange(16, "g", "k").groupBy(F.spark_partition_id()).count()
        assert ranged.agg(F.max("count")).first()[0] < 20_000 / 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = running_sums(df.where("false"), ["g"], ["k"], {"before": "n"})
    assert empty.count() == 0 and empty.columns == ["g", "k", "n", "before"]


def test_budget(spark):
    rows = [("a", "m", 1, 1, 40), ("a", "m", 1, 2, 50), ("a", "m", 2, 3, 11), ("a", "m", 3, 4, 0), ("a", "n", 9, 5, 100), ("a", "n", 9, 6, 1), ("b", "m", 1, 7, 95), ("b", "m", 2, 8, 5), (None, None, 1, 9, None)]
    asked = spark.createDataFrame(rows, "service string, month string, at long, id long, n long")
    used = spark.createDataFrame([("b", "m", 3), ("c", "m", 7), (None, None, 100)], "service string, month string, characters long")
    got = {r.id: (r.before, r.allowed) for r in U.budget_cut(asked, used, 100).collect()}
    assert got == {1: (0, True), 2: (40, True), 3: (90, False), 4: (101, False), 5: (0, True), 6: (100, False), 7: (3, True), 8: (98, False), 9: (100, True)}


def test_slots_of_lanes_never_meet():
    """Lanes that start late, wait for each other or stop keep the rate of one sender."""
    sent, now = [], [0.0]
    lanes = [T.Slots(10.0, i, 4, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0]) for i in range(4)]
    turn = threading.Lock()
    for k in range(60):
        now[0] += [0, 0.03, 0.7][k % 3]
        sent.append(lanes[k * k % 4 if k < 40 else 1].take(turn))
    ordered = sorted(round(s * 10) for s in sent)
    assert len(set(ordered)) == len(ordered)
    assert all(b - a >= 1 for a, b in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("partitions", [1, 8])
def test_a_job_keeps_its_rate(spark, partitions):
    texts = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS source_text").repartition(partitions)
    backend = T.Backend("clock", lambda text, source, target: repr(time.time()), concurrency=4, rate=20.0)
    sent = sorted(float(r.translated_text) for r in T.translate_texts(texts, backend).collect())
    assert len(sent) == 40
    # A window of a second holds twenty slots; a call may come a little after its slot has begun.
    assert all(sent[i + 21] - sent[i] >= 0.95 for i in range(len(sent) - 21))


def test_send_times_follow_the_pace(spark):
    got = T.send_times(spark.range(30).selectExpr("id", "'s' AS g"), ["id"], ["g"], base=2.0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 31)) and got[0].at_us == 0
    delays = [(b.at_us - a.at_us) / 1e6 for a, b in zip(got, got[1:])]
    for n, delay in enumerate(delays, 2):
        factor = max(f for first, f in T.STEPS if n >= first)
        assert 2.0 * T.JITTER[0] * factor <= delay <= 2.0 * T.JITTER[1] * factor
