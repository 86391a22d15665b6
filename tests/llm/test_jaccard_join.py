import random
import re

import numpy as np

from glyphflow.llm import jaccard_join as m

from .messy import documents, with_null_id


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(id, shingles, component) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=order)
                parent[y] = x
    return sorted(((d, len(sets[i]), rows[find(i)][0]) for i, (d, _) in enumerate(rows)), key=str)


def run(df, *options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in m.jaccard_join(df, *options).collect()), key=str)


def near(rng, n=220):
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 200]))] for _ in range(25)]
    rows = []
    for d in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = [rng.choice(words) for _ in range(rng.randrange(2, 16))] + passage  # unlike texts around one passage
        rows.append((d, " ".join(w)))
    return rows


def test_components_match_brute_force(spark):
    rows = near(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for small in (24, 3):
        assert run(df, small) == brute(rows)


def test_messy_table(spark):
    df, rows = documents(spark)
    assert run(df) == brute(with_null_id(rows))
    assert m.jaccard_join(df.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a + " more"), (5, b + " more"), (6, a), (7, b), (None, c), (None, c), (None, a)]
    for parts in (1, 3):
        assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == brute(rows)


def test_linked_sets_share_as_many_signatures_as_promised():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 12, 30, 90, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            keep = a[rng.random(len(a)) < 0.93]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, max(0, n // 20), dtype=np.uint64)]))
            if not m.similar(a, b):
                continue
            k = m.band(min(len(a), len(b)))
            (x, spare_a), (y, spare_b) = m.signatures(a, k), m.signatures(b, k)
            assert k in m.families(len(a)) and k in m.families(len(b))
            shared = len(set(x.tolist()) & set(y.tolist()))
            assert shared > max(spare_a, spare_b, 0) - 1 and shared >= 1
