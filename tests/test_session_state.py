import random
from datetime import datetime, timedelta, timezone
from functools import partial

import pytest

from glyphflow.operators import sessions as batch
from glyphflow.session import scratch
from glyphflow.streaming import session_state as S

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "session_id long, ts timestamp, seq long, kind string, result string"
FAR = (-1, START + timedelta(days=9999), -1, "get", None)


def brute(rows, ttl):
    """A service that looks at its clock every microsecond there is something to see."""
    told, there = [], {}
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    micro = lambda t: (t - START) // timedelta(microseconds=1) + int(START.timestamp()) * 1_000_000

    def sweep(now):
        for k, x in list(there.items()):
            if not x["busy"] and now - x["created"] > ttl:
                told.append((k, max(x["created"] + ttl, x["done"]), -1, "expire", 410, None))
                del there[k]

    for k, ts, seq, kind, result in rows:
        now = micro(ts)
        sweep(now)
        status = 200
        if kind == "create":
            there[k] = {"created": now, "busy": False, "done": 0, "result": None}
        elif k not in there:
            status = 404
        elif kind == "delete":
            del there[k]
        elif kind == "start" and there[k]["busy"]:
            status = 409
        elif kind == "start":
            there[k]["busy"] = True
        elif kind == "set_result":
            there[k] |= {"busy": False, "done": now, "result": result}
        told.append((k, now, seq, kind, status, there[k]["result"] if k in there else None))
    sweep(1 << 60)
    return sorted(told, key=str)


def operations(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(6), START + timedelta(seconds=rng.randrange(40_000), microseconds=rng.choice([0, 1, 999, 1000])), i, rng.choice(["create", "start", "start", "set_result", "delete", "get"]), f"r{i}") for i in range(n)]


def streamed(spark, batches, ttl, late="12 hours"):
    """Each batch is a file that the stream takes on its own."""
    with scratch(spark, "test") as at, S.rocks(spark):
        for i, rows in enumerate([*batches, [FAR]]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{at}/in/{i:04d}")
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
        S.session_states(read, ttl, late).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{at}/out").collect()), key=str)


@pytest.mark.parametrize("cut", ["one", "ordered", "mixed"])
def test_any_cut_into_batches(spark, cut):
    rows = operations(160, 7)
    expected = brute(rows, 3600 * 1_000_000)
    rng = random.Random(1)
    if cut == "one":
        batches = [rows]
    elif cut == "ordered":
        rows.sort(key=lambda r: r[1])
        batches = [rows[i : i + 37] for i in range(0, len(rows), 37)]
    else:  # as late as the watermark allows
        rows.sort(key=lambda r: r[1] + timedelta(hours=rng.random() * 11))
        batches = [rows[i : i + 50] for i in range(0, len(rows), 50)]
    got = streamed(spark, batches, 3600)
    assert got == expected
    assert {r[4] for r in got} == {200, 404, 409, 410}


def test_equal_to_the_batch_operators(spark):
    """Without expiry, what is stored is what operators.sessions says."""
    rows = [(k, t, i, {"get": "create"}.get(kind, kind), r) for k, t, i, kind, r in operations(200, 3)]
    rows = [(k, START + timedelta(seconds=i), i, kind, r) for k, _, i, kind, r in rows]
    got = streamed(spark, [rows[:90], rows[90:]], 10**7)
    told = [r for r in got if r[3] != "expire"]
    last = {}
    for r in sorted(told, key=lambda r: r[2]):
        last[r[0]] = r
    there = {r[0]: r[5] for r in last.values() if r[4] != 404 and r[3] != "delete"}
    df = spark.createDataFrame([(k, i, kind, r) for k, _, i, kind, r in rows], "session_id long, at long, kind string, result string")
    assert {r.session_id: r.result for r in batch.store(df).collect()} == there


def test_refusals_are_those_of_the_batch_operator(spark):
    rng = random.Random(4)
    asked = [(rng.randrange(6), START + timedelta(seconds=10 + i), 10 + i, rng.choice(["start", "start", "set_result"]), "r") for i in range(150)]
    got = streamed(spark, [[(k, START, k, "create", None) for k in range(6)], asked[:70], asked[70:]], 10**7)
    told = {(r[0], r[2]): r[4] for r in got if r[3] in ("start", "set_result")}
    requests = spark.createDataFrame([(k, i, "start" if kind == "start" else "finish") for k, _, i, kind, _ in asked], "session_id long, at long, kind string")
    assert {(r.session_id, r.at): r.status for r in batch.single_flight(requests).collect()} == told


def test_steps():
    ttl = 10
    s, status, gone = S.step(None, 0, "create", None, ttl)
    assert (s, status, gone) == (S.Session(0), 200, None)
    s, status, _ = S.step(s, 5, "start", None, ttl)
    assert status == 200 and s.end(ttl) is None
    assert S.step(s, 6, "start", None, ttl)[1] == 409
    s, status, gone = S.step(s, 50, "set_result", "x", ttl)  # still there, as it was worked on
    assert (status, gone, s.result, s.end(ttl)) == (200, None, "x", 50)
    assert S.step(s, 51, "get", None, ttl) == (None, 404, 50)
    assert S.step(S.Session(0), 10, "get", None, ttl)[1] == 200 and S.step(S.Session(0), 11, "get", None, ttl) == (None, 404, 10)


def test_sessions_that_share_a_bucket(spark, monkeypatch):
    """Without an id, without a number, without a kind or result, with ids and results that a double does not hold."""
    large = (1 << 62) + 1
    rows = [(large + k if k else None, ts, (1 << 61) + seq, kind if seq % 9 else None, result if seq % 5 else None) for k, ts, seq, kind, result in operations(240, 11)]
    rows += [(k, START + timedelta(hours=1, microseconds=7 * i + 3), None, kind, "u") for i, (k, kind) in enumerate([(None, "create"), (large + 1, "create"), (None, "start"), (None, "set_result"), (large + 1, "delete")])]
    expected = brute([r if r[2] else (*r[:2], 1 << 62, *r[3:]) for r in rows], 3600 * 1_000_000)
    expected = sorted(((*r[:2], None if r[2] == 1 << 62 else r[2], *r[3:]) for r in expected), key=str)
    rows.sort(key=lambda r: r[1])
    monkeypatch.setattr(S, "session_states", partial(S.session_states, buckets=2))
    assert streamed(spark, [rows[:90], rows[90:100], rows[100:]], 3600) == expected


def test_states_are_of_buckets(spark):
    """There are no more timers than buckets, whatever the number of sessions."""
    n = 9000
    with scratch(spark, "test") as at, S.rocks(spark):
        made = spark.range(n).selectExpr("id AS session_id", "timestamp_seconds(1704067200 + id) AS ts", "id AS seq", "'create' AS kind", "'r' AS result")
        made.coalesce(1).write.parquet(f"{at}/in/0")
        spark.createDataFrame([FAR], SCHEMA).coalesce(1).write.parquet(f"{at}/in/1")
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
        query = S.session_states(read, 60, "12 hours").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(dict(p.stateOperators[0].customMetrics)["numRegisteredTimers"] for p in query.recentProgress) <= 4096
        told = spark.read.parquet(f"{at}/out")
        assert told.where("kind = 'create' AND status = 200 AND at = (1704067200 + session_id) * 1000000").count() == n
        assert told.where("kind = 'expire' AND status = 410 AND at = (1704067260 + session_id) * 1000000").count() == n and told.count() == 2 * n
