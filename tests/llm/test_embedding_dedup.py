import numpy as np
import pytest

from glyphflow.llm import embedding_dedup as m

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, weight long, links long"


def test_recall_and_precision(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 24))
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 24)) * 0.15, np.repeat(base[:1], 40, axis=0), base[1:2] + rng.normal(size=(60, 24)) * 0.1]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1, 2, 3) for i, v in enumerate(x)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] * 24), (n + 3, [1.0, None] + [0.0] * 22), (n + 4, [1.0, 2.0]), (n + 5, []), (n + 6, [float("inf")] + [1.0] * 23)]
    rows += [(i, v, 0, 1, 2, 3) for i, v in odd]
    got = {r.vec_id: r for r in m.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == n + 7
    u = m.unit(x.astype(np.float64))
    link = u @ u.T >= m.COSINE
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(n))
    assert found <= link.sum() and found >= 0.98 * link.sum()
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], n).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i].component_id == label[i] for i in range(n)]) > 0.98
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)


def test_empty(spark):
    assert m.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_judge_each_pair_once():
    rng = np.random.default_rng(1)
    x = m.unit(rng.normal(size=(40, 8)))
    near = m.nearest_pivots(x, m.unit(rng.normal(size=(6, 8))))
    keys = m.pair_keys(near)
    total = np.zeros(40, np.int64)
    for key in np.unique(keys):
        at = np.flatnonzero((keys == key).any(axis=1))
        links, _ = m.verify(at.astype(np.int64), np.ones(len(at), np.int64), near[at], x[at], int(key), None, cosine=-1.0)
        total[at] += links
    assert (total == 39).all()  # five of six pivots each, so every pair shares two and more


def test_null_and_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v), (2, v), (1, v), (None, w), (None, w), (4, w), (5, [1.0, 2.0])]
    for parts in (1, 3):
        got = m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)).collect()
        want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (4, 2, 4, True), (None, 2, 4, False), (None, 2, 4, False), (5, 0, 5, True)]
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)


def test_every_dimension_is_indexed(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    rare = rng.normal(size=5)
    rows += [(1000, rare.tolist()), (1001, (rare + 0.01).tolist()), (1002, [7.0]), (1003, [2.0])]
    got = {r.vec_id: r for r in m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert got[1001].component_id == 1000 and got[1001].n_links == 1 and got[1003].component_id == 1002


@pytest.mark.parametrize("dimension", [64, 384, 768])
@pytest.mark.parametrize("lean", [0.0, 0.4, 1.0, 1.5])
def test_pairs_at_the_threshold_meet(dimension, lean):
    """Whether vectors point anywhere or mostly one way: pivots, and how many of them, come from the vectors."""
    rng = np.random.default_rng(6)
    one_way = m.unit(rng.normal(size=(1, dimension)))
    x = m.unit(m.unit(rng.normal(size=(2500, dimension))) + lean * one_way)
    pivots = m.choose_pivots(list(x[:2048]), 512)[dimension]
    near = m.nearest_needed(x[:2048], pivots)
    y = m.turned(x[1500:], 0.951, seed=9)
    a, b = m.nearest_pivots(x[1500:], pivots, near), m.nearest_pivots(y, pivots, near)
    shared = np.array([len(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    assert (shared >= 2).mean() >= 0.95, (near, (shared >= 2).mean())


def test_many_pivots():
    rng = np.random.default_rng(6)
    for dimension in (32, 384):
        x = m.unit(rng.normal(size=(600, dimension)))
        for n in (2048, 8192):
            pivots = m.unit(rng.normal(size=(n, dimension)))
            near = m.nearest_needed(x[:300], pivots)
            a, b = m.nearest_pivots(x[300:], pivots, near), m.nearest_pivots(m.turned(x[300:], 0.951, seed=3), pivots, near)
            shared = np.array([len(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
            assert (shared >= 2).mean() >= 0.92, (dimension, n, near)


def test_vectors_that_lean_one_way(spark):
    """The operator itself on 384 dimensions, mean cosine about 0.69, pairs at the threshold."""
    rng = np.random.default_rng(12)
    x = m.unit(m.unit(rng.normal(size=(2100, 384))) + 1.5 * m.unit(rng.normal(size=(1, 384))))
    y = m.turned(x[:400], 0.952, seed=5)
    assert 0.6 < (x[:500] @ x[500:1000].T).mean() < 0.75
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r.component_id for r in m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[2100 + i] == i for i in range(400)]) >= 0.95


def test_packed_vectors():
    for v in ([1.0, 0.5], [0.1, 1e300], [1e-300, 1.0], [float(np.float32(0.1)), 3.0]):
        packed = m.pack(np.array(v))
        assert m.dimension_of(packed) == 2 and m.unpack([packed]).tolist() == [v]
    assert len(m.pack(np.array([0.5, 1.0]))) == 9


def test_folding_in_parts(spark, monkeypatch):
    """A task that may hold little writes its table again and again; links stay."""
    monkeypatch.setattr(m, "FOLD", 300)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(20, 6)).astype(np.float32), 30, axis=0)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50), pa.int64()), pa.array([v.tolist() for v in x[i : i + 50]], pa.list_(pa.float64()))], names=["vec_id", "embedding"]) for i in range(0, 600, 50)]
    out = [r for b in m._fold(iter(batches)) for r in b.to_pylist()]
    assert sum(r["weight"] or 0 for r in out) == 600 and sum(r["vector"] is not None for r in out) > 20
