import random

from glyphflow.llm.components import components, spanning_forest
from glyphflow.llm.workspace import Workspace


def brute(pairs):
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_paths_stars_and_loops(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    rng.shuffle(pairs)
    with Workspace(spark, "t") as ws:
        links = spark.createDataFrame(pairs, "a long, b long").repartition(9)
        got = {r.node: r.component for r in components(ws, links).collect()}
    want = {k: v for k, v in brute([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want


def test_no_links(spark):
    with Workspace(spark, "t") as ws:
        assert components(ws, spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    assert sorted(spanning_forest([(3, 2), (2, 9), (7, 8), (8, 7)])) == [(3, 2), (8, 7), (9, 2)]
