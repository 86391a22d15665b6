import hashlib
import re

from glyphflow.llm.mixing import mix, targets

from .messy import documents


def test_shares_and_caps(spark):
    df, rows = documents(spark)
    got = mix(df).collect()
    assert len(got) == len(rows) + 1  # null ids are mixed too
    sizes, taken, target = {}, {}, {}
    source = {r.doc_id: r.source for r in df.collect()}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(taken[s] == int(target[s]) for s in sizes)
    assert all(target[s] <= 2 * sizes[s] for s in sizes)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows for r in got if r.doc_id == d and d != 10)


def test_order_is_by_hash_and_reruns_agree(spark):
    df, rows = documents(spark)
    first, second = (sorted(map(tuple, mix(df.repartition(k)).fillna(-1).collect())) for k in (1, 5))
    assert first == second
    key = lambda d: hashlib.md5(f"mix-1:{d}".encode()).hexdigest()
    source = {r.doc_id: r.source for r in df.collect()}
    by = {}
    for d, size, total, target, taken in first:
        if d >= 0 and source[d] is not None and size:
            by.setdefault(source[d], []).append((key(d), taken / size))
    for rows in by.values():
        shares = [s for _, s in sorted(rows)]
        assert shares == sorted(shares, reverse=True)


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes).collect()}
    assert got["a"] == 20 and got["d"] == 0 and got[None] == 100
    assert abs(got["b"] * 2 - got["c"]) < 1e-9 and abs(sum(got.values()) - 1.5 * 2060) < 1e-6


def test_empty(spark):
    df, _ = documents(spark)
    assert mix(df.where("false")).count() == 0
    assert {r.taken for r in mix(df.where("doc_id < 3")).collect()} == {0}


def test_rows_of_one_id_and_size_keep_their_turn(spark):
    """Whatever order they come in, the same texts are taken twice, once or in part."""
    rows = [(7, f"{c} {c}{c} {c}", "s", i) for i, c in enumerate("abcdefghi")] + [(8, "one two", "t", 20), (None, "x y", "s", 21), (None, "y x", "s", 22)]
    found = []
    for turn in range(4):
        df = spark.createDataFrame(rows[turn * 3 :] + rows[: turn * 3], "doc_id long, text string, source string, turn long").repartition(turn + 1)
        found.append(sorted(tuple(r) for r in mix(df, share=1.3, row="turn").select("turn", "taken").collect()))
    assert all(f == found[0] for f in found) and len({t for _, t in found[0]}) > 1


def test_rows_without_an_id_are_in_an_order_of_their_own(spark):
    """Their keys are as random as those of others, so no range of keys has them all, and reruns agree."""
    df = spark.range(6000).selectExpr("cast(null AS long) AS doc_id", "concat('w', id, repeat(' x', cast(id % 3 AS int))) AS text", "'s' AS source", "id AS turn")
    keys = df.selectExpr("substring(md5(concat('mix-1:null:', md5(text))), 1, 3) AS k").groupBy("k").count()
    assert keys.count() > 2500 and keys.agg({"count": "max"}).first()[0] < 20
    first, second = ({r.turn: r.taken for r in mix(df.repartition(k), share=0.4, row="turn").collect()} for k in (2, 5))
    assert first == second
    taken = [t for t, n in first.items() if n]
    assert {t % 3 for t in taken} == {0, 1, 2} and min(taken) < 600 and max(taken) > 5400
