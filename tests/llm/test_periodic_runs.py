import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphflow.llm import periodic_runs as R

from .messy import documents, with_null_id


def brute_runs(w, least=R.LEAST, times=R.TIMES):
    """Every period tried at every place; an interval has the smallest period that gives it."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(w, least=R.LEAST, times=R.TIMES):
    w = np.array(w, np.int64)
    return [(s, e - s, p) for s, e, p in R.find_runs(w, np.array([0, len(w)]), least, times).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=9), st.sampled_from([(24, 3), (3, 3), (5, 4)]))
def test_runs_of_random_powers(parts, kind):
    w = [x for part, k in parts for x in part * k]
    assert found(w, *kind) == brute_runs(w, *kind)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("w", [[0] * 500, [0, 1] * 300, thue_morse(4096), [0] * 23, [0] * 24, list(range(8)) * 3, list(range(9)) * 3 + [0], list(range(100)), [], [5]])
def test_special_words(w):
    assert found(w) == brute_runs(w)


def test_several_documents_do_not_run_together():
    docs = [[0, 1] * 6, [0, 1] * 6, [], [0, 1] * 20, [1, 0] * 20]
    bounds = np.cumsum([0] + [len(d) for d in docs])
    runs = R.find_runs(np.array(sum(docs, []), np.int64), bounds)
    assert runs.tolist() == [[24, 64, 2], [64, 104, 2]]


def test_small_steps_and_words_compared_themselves():
    rng = np.random.default_rng(5)
    w = np.concatenate([np.tile(rng.integers(0, 3, p), 40 // p + 3) for p in rng.integers(1, 30, 40)]).astype(np.int64)
    ends = np.array([0]), np.array([len(w)])
    expected = [(s, s + n, p) for s, n, p in brute_runs(w.tolist())]
    for z in (R.Prefixes(w), R.Compared(w)):
        for step in (7, 64, 1 << 20):
            assert R.crossing(w, *ends, z, R.LEAST, R.TIMES, step).tolist() == [list(x) for x in expected]


def test_colliding_hashes_are_found_out(monkeypatch):
    """Hashes that call everything equal give wrong runs, and the words themselves the right ones."""
    monkeypatch.setattr(R.Prefixes, "equal", lambda self, x, y, k: np.ones(len(x), bool))
    w = [1, 2, 3] * 20 + list(range(10, 60)) + [1, 2] * 30
    assert found(w) == brute_runs(w)


def test_words_in_pieces():
    text = b"\x0b one two\tthree\r\n four " * 50 + b"\xc2\x85 five"
    v = R.Vocabulary()
    names = R.intern(text, v, 7)
    assert [list(v)[i] for i in names] == text.split()
    assert len(R.intern(b" \n ", v)) == len(R.intern(b"", v)) == 0


def test_documents_against_brute_force(spark):
    df, rows = documents(spark, n=120)
    rng = np.random.default_rng(1)
    more = [(1000 + i, " ".join(" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(1, 12))) + " " for _ in [0]) * int(rng.integers(3, 30))) for i in range(60)]
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, R.periodic_runs(df, alter=True).collect()), key=key)
    expected = sorted((brute(d, t) for d, t in with_null_id(rows) + more if len(t or "") < 30_000), key=key)
    assert [r for r in got if r[0] != 4] == expected
    assert sum(r[1] > 0 for r in expected) > 30


def test_a_very_long_text(spark):
    text = "one two three " * 200_000 + "end"
    r = R.periodic_runs(spark.createDataFrame([(2, text)], "doc_id long, text string")).first()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 600_000, 3)
    assert r.collapsed_sha256 == hashlib.sha256(b"one two three end").hexdigest()


def test_empty(spark):
    df, _ = documents(spark)
    assert R.periodic_runs(df.where("false")).count() == 0
    assert R.periodic_runs(df.where("doc_id < 3")).select("n_runs", "start").distinct().collect() == [(0, None)]
