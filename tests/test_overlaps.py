import random
import time

import numpy as np
import pytest

from glyphflow.operators import layout, overlaps

SCHEMA = "doc_id long, page_number int, block_idx long, raw_text string, position struct<x0:double,y0:double,x1:double,y1:double>"


def frame(spark, boxes):
    return spark.createDataFrame([(d, p, i, "t", b) for d, p, i, b in boxes], SCHEMA).repartition(3)


def brute_pairs(boxes):
    out = set()
    for d, p, i, a in boxes:
        for e, q, j, b in boxes:
            if (d, p) == (e, q) and i < j and a and b and None not in (*a, *b) and not (a[2] < b[0] or a[0] > b[2]) and not (a[3] < b[1] or a[1] > b[3]):
                out.add((d, p, i, j))
    return out


def brute_moved(boxes, gap):
    out = {}
    for d, p in {(d, p) for d, p, _, _ in boxes}:
        placed = []
        for i, (x0, y0, x1, y1) in sorted(((i, b) for e, q, i, b in boxes if (e, q) == (d, p)), key=lambda r: (r[1][1], r[1][0], r[0])):
            y = max([y0, *(end + gap for a, b, end in placed if not (x1 < a or x0 > b))])
            placed.append((x0, x1, y + (y1 - y0)))
            out[d, p, i] = (y, y + (y1 - y0))
    return out


def some_boxes(kind, n, seed=2):
    """Pages that a grid of one size would not suit."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(0, 600), rng.uniform(0, 800), rng.uniform(0, 60), rng.uniform(0, 12)
        if kind == "clusters":
            x, y = x / 1000 + rng.choice([0, 1e7, -5e12]), y / 1000
            w, h = w / 1000, h / 1000
        elif kind == "columns":
            x, y, w, h = i * 2.0, 0.0, rng.choice([0.0, 1.0, 2.0]), 800.0
        elif kind == "sizes":
            w, h = 4.0 ** rng.randrange(-6, 6), 4.0 ** rng.randrange(-6, 6)
        elif kind == "touching":
            x, y, w, h = float(rng.randrange(20)), float(rng.randrange(20)), float(rng.randrange(3)), float(rng.randrange(3))
        out.append((rng.choice([1, None]) if kind == "sizes" else 1, rng.randrange(2), i, (x, y, x + w, y + h)))
    return out


@pytest.mark.parametrize("kind", ["plain", "clusters", "columns", "sizes", "touching"])
def test_pairs_of_large_pages(spark, kind):
    boxes = some_boxes(kind, 160)
    got = layout.overlap_pairs(frame(spark, [b for b in boxes if b[0]]), many=10).collect()
    expected = brute_pairs([b for b in boxes if b[0]])
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) and expected


def test_odd_boxes(spark):
    nan = float("nan")
    boxes = [(1, 1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, 1, (8.0, 8.0, 2.0, 2.0)), (1, 1, 2, None), (1, 1, 3, (None, 0.0, 1.0, 1.0)), (1, 1, 4, (5.0, 5.0, 5.0, 5.0)), (1, 1, 5, (5.0, 5.0, 5.0, 5.0)), (1, 1, 6, (-1e300, -1e300, 1e300, 1e300))]
    expected = brute_pairs(boxes)
    for many in (0, 100):
        assert {tuple(r) for r in layout.overlap_pairs(frame(spark, boxes), many=many).collect()} == expected
    assert layout.overlap_pairs(frame(spark, [(1, 1, i, (nan, 0.0, 1.0, 1.0)) for i in range(3)]), many=0).count() == 0
    assert layout.overlap_pairs(frame(spark, boxes).where("false")).count() == 0


@pytest.mark.parametrize("kind", ["plain", "columns", "touching"])
def test_sweep_against_fold(spark, kind):
    boxes = some_boxes(kind, 150)
    expected = brute_moved(boxes, 4.0)
    for many in (5, 1000):
        got = {(r.doc_id, r.page_number, r.block_idx): (r.adj_y0, r.adj_y1) for r in layout.resolve_overlaps(frame(spark, boxes), many=many).collect()}
        assert got == expected


def test_a_page_of_a_hundred_thousand_blocks(spark):
    """Both take seconds; all pairs would be five billion."""
    n = 100_000
    df = spark.range(n).selectExpr("1L AS doc_id", "1 AS page_number", "id AS block_idx", "'t' AS raw_text", "named_struct('x0', (id % 1000) * 10D, 'y0', (id div 1000) * 10D, 'x1', (id % 1000) * 10D + 9 + (id % 2), 'y1', (id div 1000) * 10D + 9) AS position")
    began = time.time()
    assert layout.overlap_pairs(df).count() == n // 2 - 100  # every second block touches the next one of its row
    moved = layout.resolve_overlaps(df).selectExpr("max(adj_y1) AS most", "count(*) AS n").first()
    assert moved.n == n and moved.most > 1000
    assert time.time() - began < 120


def test_skyline():
    rng = random.Random(3)
    line, plain = overlaps.Skyline(37), np.full(37, -np.inf)
    for _ in range(300):
        a, b = sorted((rng.randrange(37), rng.randrange(37)))
        assert line.over(a, b) == plain[a : b + 1].max()
        end = rng.random()
        line.put(a, b, end)
        plain[a : b + 1] = np.maximum(plain[a : b + 1], end)
