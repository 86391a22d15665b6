import hashlib
import random

import numpy as np

from glyphflow.llm import substring_dedup as m

from .messy import documents, with_null_id


def brute(rows):
    """Per row, in the order of ids: n_bytes, n_removed, n_spans and a hash of what is left."""
    seen, out = {}, []
    for n, (doc, text) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - m.LENGTH + 1):
            w = data[s : s + m.LENGTH]
            if seen.setdefault(w, (n, s)) < (n, s):
                gone[s : s + m.LENGTH] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[0] if len(gone) else 0) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.remove_repeats(df, **options).collect()), key=str)


def texts(rng):
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(50, 500))) for _ in range(5)]
    return [(d * 2, "".join(rng.choice(base)[rng.randrange(40) :] + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(0, 6)))) for d in range(40)]


def test_matches_brute_force(spark):
    rows = texts(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df) == brute(rows)


def test_messy_table(spark):
    df, rows = documents(spark)
    assert run(df) == brute(with_null_id(rows))
    assert m.remove_repeats(df.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(1)
    a, b, c = ("".join(rng.choice("abcdefgh") for _ in range(124)) for _ in range(3))
    rows = [(1, a + "xxxxx"), (2, b), (2, a), (None, c), (None, c[2:] + "z"), (3, c)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = run(df)
        assert [g[:4] for g in got if g[0] == 2] == [(2, 124, 0, 0), (2, 124, 124, 1)]
        assert sorted(g[2] for g in got if g[0] is None) == [122, 124]


def test_hot_anchors(spark):
    """Bands, and windows where bands are hot too, give what whole pieces give."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    around = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randrange(1, 90)))
    rows = texts(rng) + [(1000 + d, around() + passage + around()) for d in range(60)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (1, 4, 20, m.HOT):
        assert run(df, hot=hot) == want
    kinds = set()
    for batch in m._own(4)(_owner_batches(rows)):
        kinds |= set(batch.column("kind").to_pylist())
    assert kinds == {0, 1, 2}


def test_hot_windows_are_folded_before_they_are_sent():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(d, "".join(rng.choice("xyz") for _ in range(80)) + passage + "".join(rng.choice("xyz") for _ in range(80))) for d in range(300)]
    windows = sent = 0
    wanted = {}
    for batch in m._own(4)(_owner_batches(rows)):
        for kind, doc, lo, size, gram in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc_id", "lo", "size", "gram")), strict=True):
            if kind == 2:
                wanted.setdefault(doc, []).append({"kind": kind, "lo": lo, "size": size, "gram": gram})
                windows += size - m.LENGTH + 1
    import pyarrow as pa
    import zstandard

    text = dict(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(list(wanted)), pa.array([zstandard.compress(text[d].encode()) for d in wanted]), pa.array(list(wanted.values()))], names=["doc_id", "blob", "wanted"])
    for out in m._cut_pieces(4)(iter([batch])):
        sent += sum(len(p) for p in out.column("piece").to_pylist() if p is not None)
    assert windows > 20_000 and sent < windows * m.LENGTH / 5


def _owner_batches(rows):
    import pyarrow as pa
    from pyspark import TaskContext

    class Fake:
        @staticmethod
        def partitionId():
            return 0

    before, TaskContext.get = TaskContext.get, staticmethod(lambda: Fake)
    try:
        docs = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
        yield from list(m._anchor(1)(iter([docs])))
    finally:
        TaskContext.get = before


def test_matching_statistics_are_common_prefixes():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(30)]
    index = m.RunLengthIndex(pieces)
    suffix = []
    for p in pieces:
        suffix += [p[i:] for i in range(len(p) + 1)]
    order = sorted(range(len(suffix)), key=lambda i: (suffix[i], i))
    share, before = index.matching_statistics(np.arange(index.n))
    for a, b in zip(order, order[1:]):
        n = 0
        while n < min(len(suffix[a]), len(suffix[b])) and suffix[a][n] == suffix[b][n]:
            n += 1
        assert share[b] == n and (n == 0 or before[b] == a)
    assert share[order[0]] == 0 and index.length.sum() == index.n
    for length in (1, 3, 8):
        first = {}
        want = [i for i, x in enumerate(suffix) if len(x) >= length and first.setdefault(x[:length], i) != i]
        assert index.repeated(length).tolist() == want


def test_repetitive_pieces_have_few_runs():
    rng = random.Random(4)
    base = "".join(rng.choice("abcd") for _ in range(160)).encode()
    one, many = (m.RunLengthIndex([base[:i] + b"x" + base[i + 1 :] for i in range(0, 160, step)]) for step in (160, 2))
    assert many.n > 70 * one.n and many.runs < 8 * one.runs
