import math
import random
import zlib

from glyphflow.llm.toxicity import CLASS, DISCOUNT, Ratios, class_counts, fit_rows_of, score_toxicity, shared_counts, shared_model
from glyphflow.llm.workspace import Workspace

from .messy import documents


def corpus(rng, n=900):
    words = ["".join(rng.choice(["an", "the", "re", "on", "is", "or"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["blorgvex", "quzzag", "snarfle"]
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "."])
        docs.append((d, " ".join(w), "x"))
        labels.append((d, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(random.Random(7))
    got = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = {d: t for d, _, t in labels}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    caught = sum(r.predicted and want[r.doc_id] for r in held)
    assert caught >= 0.9 * sum(want[r.doc_id] for r in held)
    assert caught >= 0.95 * sum(r.predicted for r in held)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(random.Random(7), 300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    a, b = ({r.doc_id: r.score for r in score_toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_messy_tables(spark):
    df, rows = documents(spark)
    labels = spark.createDataFrame([(d, 1, [0, 1, None][d % 3]) for d, _ in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_toxicity(df, labels).collect()
    assert len(got) == len(rows) + 1
    empty = score_toxicity(df, labels.where("false")).collect()
    assert {r.score for r in empty} == {0.5} and {r.predicted for r in empty} == {0}
    assert score_toxicity(df.where("false"), labels).count() == 0


def test_every_document_counts_for_the_shared_backoff(spark):
    docs, labels = corpus(random.Random(7), 300)
    schema = "doc_id long, text string, toxic string"
    more = [(10_000 + i, "blorgvex snarfle " * 200, "x") for i in range(20)]  # not labelled, of known words
    bad = [d for d, _, t in labels if t]
    a, b = ({r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(x, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()} for x in (docs, docs + more))
    assert any(abs(a[d] - b[d]) > 1e-9 for d in bad)


def test_shared_counts_match_brute_force(spark):
    texts = ["ab abc", "abc  ABC é", None, "", "abcdefgh" * 3]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").repartition(3)
    strings, contexts = {}, {}
    for w in (w for t in texts * 2 for w in (t or "").lower().encode().split()):
        spelt = b" " + w + b" "
        for i in range(1, len(spelt)):
            context = spelt[max(0, i - 5) : i]
            strings[context + spelt[i : i + 1]] = strings.get(context + spelt[i : i + 1], 0) + 1
            contexts.setdefault(context, set()).add(spelt[i])
    with Workspace(spark, "test") as ws:
        got, found = shared_counts(df, ws)
        assert sorted(r.shared_n for r in got.collect()) == sorted(strings.values())
        assert sorted(r.shared_kinds for r in found.collect()) == sorted(map(len, contexts.values()))
        assert sum(r.shared_total for r in found.collect()) == sum(strings.values())


def test_ordinary_words_are_evidence_too(spark):
    docs, labels = corpus(random.Random(7), 300)
    plain = next(t for (d, t, _), (_, _, toxic) in zip(docs, labels, strict=True) if not toxic)
    df = spark.createDataFrame([*docs, (10_000, plain, "x"), (10_001, "", "x")], "doc_id long, text string, toxic string")
    got = {r.doc_id: r.score for r in score_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert abs(got[10_000] - got[10_001]) > 1e-9


def _spelt(texts):
    return [b" " + w + b" " for t in texts for w in (t or "").lower().encode().split()]


def _strings(texts):
    """(context, character) of every character of every word, word ends included."""
    return [(w[max(0, i - 5) : i], w[i]) for w in _spelt(texts) for i in range(1, len(w))]


def _triples(texts):
    """Probability of the last class of a triple by Kneser-Ney continuation counts."""
    c = lambda w, i: int(CLASS[w[i]]) if i >= 0 else 0
    quads = {tuple(c(w, i - k) for k in (3, 2, 1, 0)) for w in _spelt(texts) for i in range(1, len(w))}
    three, two = {}, {}
    for q in quads:
        three[q[1:]] = three.get(q[1:], 0) + 1
    for t in three:
        two[t[1:]] = two.get(t[1:], 0) + 1
    one = [sum(1 for t in two if t[1] == x) + 0.5 for x in range(64)]

    def level(counts, context, x, below):
        of = [n for key, n in counts.items() if key[:-1] == context]
        if not of:
            return below
        return max(counts.get((*context, x), 0) - DISCOUNT, 0) / sum(of) + DISCOUNT * len(of) / sum(of) * below

    return lambda a, b, x: level(three, (a, b), x, level(two, (b,), x, one[x] / sum(one)))


def test_ratios_match_brute_force_kneser_ney(spark):
    toxic, ordinary, rest = ["vex blorg vex", "blorgs!"], ["the vexing theory", "other blo", "the"], ["bl the\u00e9 or or", None, "vexed"]
    texts = [*toxic, *ordinary, *rest]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    fit = spark.createDataFrame([(0, t) for t in toxic] + [(1, t) for t in ordinary], "group long, text string")
    with Workspace(spark, "test") as ws:
        model = Ratios(class_counts(fit, *shared_counts(docs, ws), ws), shared_model(docs))
    triple, every = _triples(texts), _strings(texts)

    def kneser_ney(strings, context, x, below):
        of = [y for c, y in strings if c == context]
        if not of:
            return below, 1.0
        left = DISCOUNT * len(set(of)) / len(of)
        return max(of.count(x) - DISCOUNT, 0) / len(of) + left * below, left

    classes = [_strings(toxic), _strings(ordinary)]
    for t in ["blorg vex", "the vexes", "unseen zzz", "", "vex"]:
        want = 0.0
        for w in _spelt([t]):
            for i in range(1, len(w)):
                context, x = w[max(0, i - 5) : i], w[i]
                below = kneser_ney(every, context, x, triple(int(CLASS[w[i - 2]]) if i > 1 else 0, int(CLASS[w[i - 1]]), int(CLASS[x])))[0]
                (p, p_left), (q, q_left) = (kneser_ney(s, context, x, below) for s in classes)
                met = any((context, x) in s for s in classes)  # where neither class has the string, what both hand down cancels
                want += math.log(p / q) if met else math.log(p_left / q_left)
        total, n = model.ratios([t.encode()])
        assert n[0] == len(t.split()) and abs(total[0][0] - want) < 1e-4  # values are kept in single precision


def test_fit_is_bounded_in_bytes(spark):
    docs, labels = corpus(random.Random(7), 200)
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(df, marks, fit_bytes=0).collect()} == {0.5}
    few = score_toxicity(df, marks, fit_bytes=20_000).collect()
    assert len(few) == 200 and len({r.score for r in few}) > 1


def test_fit_is_bounded_for_repeated_rows(spark):
    rows = [(d, f"text {d} " * 20) for d in range(30)]
    one, two = [d for d in range(30) if zlib.crc32(str(d).encode()) % 3 != 1][:2]
    same, other = [(one, "equal rows of one id " * 50)] * 3000, [(two, f"row {i} of one id") for i in range(300)]
    df = spark.createDataFrame([*rows, *same, *other], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, d % 2) for d in range(30)], "doc_id long, toxic int")
    fits = {(d, t) for d, t in [*rows, *same, *other] if zlib.crc32(str(d).encode()) % 3 != 1}
    with Workspace(spark, "test") as ws:
        for n, size in ((40_000, 1 << 20), (25, 1 << 20), (40_000, 5_000)):
            got = fit_rows_of(df, labels, ws, n, size).collect()
            assert len(got) <= n and sum(len(r.text) for r in got) <= size and {r.text for r in got} <= {t for _, t in fits}
            assert got and (n < 40_000 or size < 1 << 20 or len(got) == len(fits))


def test_logistic_fit_settles_however_well_classes_part():
    import numpy as np

    from glyphflow.llm.toxicity import fit_logistic

    rng = np.random.default_rng(3)
    for n, gap, scale in ((40_000, 8.0, 1.0), (5_000, 30.0, 0.01), (500, 0.5, 50.0), (200, 1000.0, 1.0)):
        y = (rng.random(n) < 0.1).astype(float)
        base = y * gap + rng.normal(size=n)
        x = np.stack([np.ones(n), base * scale, base * scale + rng.normal(size=n) * 1e-3, np.maximum(base - 2, 0), rng.normal(size=n)], axis=1)
        w = fit_logistic(x, y)
        z = x / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        u = w * np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        p = 1 / (1 + np.exp(-np.clip(z @ u, -500, 500)))
        gradient = z.T @ (y - p) - np.where(np.arange(5) > 0, u, 0)
        assert abs(gradient).max() < 0.05 and abs(p.sum() - y.sum()) < 0.05  # the least loss, and as many as there are
        if gap >= 8:
            assert ((p >= 0.7) == (y == 1)).mean() > 0.99
    assert (fit_logistic(np.ones((3, 2)), np.ones(3)) == 0).all()


def test_strings_of_the_classes_have_a_bound(spark):
    """Letters at random give about a string each; what is kept are those that are met often enough."""
    import random

    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400)) + " common words here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fit = docs.selectExpr("doc_id % 2 AS `group`", "text")
    with Workspace(spark, "test") as ws:
        shared = shared_counts(docs, ws)
        every = class_counts(fit, *shared, ws)
        some = class_counts(fit, *shared, ws, most=1000)
    total = lambda t: sum(t.column(c).to_numpy() for c in ("toxic_0", "ordinary_0", "toxic_1", "ordinary_1"))
    assert every.num_rows > 15_000 and 0 < some.num_rows <= 1000
    assert total(some).min() > 1 and (total(every) >= total(some).min()).sum() == some.num_rows
    scored = score_toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert scored.count() == 60


def test_many_short_rows_keep_their_ids(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 7 = 0, null, concat('w', id % 50)) AS text", "-id AS row").repartition(2)
    scored = score_toxicity(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int"), row="row")
    assert scored.where("row = -doc_id").count() == 30_000 and scored.selectExpr("count(DISTINCT doc_id)").first()[0] == 30_000


def test_more_strings_than_arrays_hold_give_the_same_scores(spark):
    docs, labels = corpus(random.Random(9), 300)
    rows = [(i, t) for i, t, *_ in docs] + [(None, "no id"), (3, None), (3, ""), (3, "twice the id")]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    told = lambda most: sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.predicted, r.score) for r in score_toxicity(df, marks, most=most).collect()))
    by_arrays, by_joins = told(10**6), told(100)
    assert len(by_arrays) == len(rows) and len({x[4] for x in by_arrays}) > 100
    assert all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-4 for a, b in zip(by_arrays, by_joins, strict=True))
