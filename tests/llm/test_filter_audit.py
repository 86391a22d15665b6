import os
import re
from itertools import permutations

import duckdb
import pytest

from glyphflow.llm.filter_audit import ORACLE, audit, op13_filter_audit

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int, extra string"


def brute(rows, labels):
    """Every document walked through every order."""
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t, _ in labels if t == 1 and d is not None}
    docs = []
    for d, text, source in rows:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        earlier = [e for e, t, _ in rows if (t or "") == text and e is not None and d is not None and e < d]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": bool(earlier)}
        docs.append((source or "", {k for k, v in fails.items() if v}, d in good, d in bad))
    out, removed = {}, {}
    for part in {p for p, *_ in docs}:
        for order in map("".join, permutations("ABCDE")):
            alive = [x for x in docs if x[0] == part]
            dead = []
            for step, k in enumerate(order, 1):
                here = [x for x in alive if k in x[1]]
                redundant = sum(k in x[1] for x in dead)
                alive = [x for x in alive if k not in x[1]]
                dead += here
                out[part, order, step] = [len(alive), len(here), redundant, sum(x[0] == part and x[1] == {k} for x in docs), sum(x[2] for x in here), sum(x[3] for x in here)]
                removed[part, k] = removed.get((part, k), 0) + len(here)
    return {(p, o, s): (*v, removed[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def corpus():
    plain = " ".join(f"word{i}" for i in range(60))
    return [
        (5, plain, "a"), (2, plain, "b"), (9, plain, "a"), (9, plain, "a"), (7, plain + " ", "a"), (None, plain, "a"), (None, plain, None),
        (11, None, "a"), (12, "", ""), (13, " \t\n", None), (14, "A" * 10, "b"), (15, "same " * 80, "b"), (16, "SAME " * 80 + "#", "b"), (17, plain + " |", "c"),
        (18, "\x85" * 60 + " b", "c"), (19, "x" * 50_000, "c"), (20, "Ω à " * 30, "c"), (-3, "AB" + plain, "c"), (16, "SAME " * 80 + "#", "b"),
    ]


def test_every_order_against_brute_force(spark):
    rows = corpus()
    labels = [(5, 1, 0, "x"), (9, 1, 1, "x"), (9, 0, 0, "x"), (14, None, 1, "x"), (15, 1, None, "x"), (None, 1, 1, "x"), (77, 1, 1, "x"), (17, 2, 5, "x")]
    df = spark.createDataFrame([(*r, 1, "d", 3) for r in rows], "doc_id long, text string, source string, mask int, digest string, step int").repartition(3)
    got = audit(df, spark.createDataFrame(labels, LABELS))
    assert found(got) == brute(rows, labels)
    assert got.schema["step"].dataType.typeName() == "integer" and got.schema["kept"].dataType.typeName() == "long"


def test_sql_agrees_with_brute_force():
    rows, labels = corpus(), [(5, 1, 0, "x"), (9, 1, 1, "x"), (9, 0, 0, "x"), (None, 1, 1, "x")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT, x VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?, ?)", labels)
    got = {r[:3]: r[3:] for r in con.sql(ORACLE).fetchall()}
    assert got == brute(rows, labels)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(df, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, "a", None)], df.schema)
    assert audit(one, spark.createDataFrame([], LABELS)).count() == 600


def test_fewer_filters_and_a_hot_group(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copy', concat('text ', id)) AS text", "'hot' AS source")
    got = found(audit(df, spark.createDataFrame([], LABELS), "AE"))
    assert got["hot", "EA", 1][:3] == (4000 - 1333, 1333, 0) and got["hot", "AE", 2][:3] == (0, 0, 1333)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_query(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert found(op13_filter_audit(spark, SMALL)) == {r[:3]: r[3:] for r in con.sql(ORACLE).fetchall()}
