import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from glyphflow.llm.bpe import ForcedBoundaryBPE, vocabulary_path  # noqa: E402

from . import test_exact_dedup, test_jaccard_join  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    from . import test_toxicity

    docs, labels = test_toxicity.corpus(random.Random(11), 400)
    rng = random.Random(5)
    rows = [(d, t, "en", f"src{d % 3}", len(t), "extra") for d, t, _ in docs]
    rows += [(1000 + i, rows[i * 3][1], "en", None, 1, "x") for i in range(30)]
    for i in range(30):
        w = rows[i * 5][1].split()
        w[rng.randrange(len(w))] = "other"
        rows.append((2000 + i, " ".join(w), "en", "src1", 1, "x"))
    rows += [(3000, None, None, None, None, None), (3001, "", "en", "src0", 0, "x"), (None, "the anon isre reor onisthe an or", "en", "src0", 5, "x"), (None, "onor isis there anre oror the", None, "src1", 8, "x"), (3001, "isthe or onre anan theis reon is", "en", "src2", 3, "x")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_match_brute_force(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        after = spark.read.parquet(f"{path}/{k}")
        rows = after.collect()
        if k < 4:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars", "size"]
        if name == "toxicity":
            bad = sum(any(x in (t or "") for x in ("blorgvex", "quzzag", "snarfle")) for _, t, _ in before)
            assert abs(len(before) - len(rows) - bad) <= 0.1 * bad and {None, 3000, 3001} <= {r.doc_id for r in rows}
            assert sum(r.doc_id in (None, 3001) for r in rows) == 4
        elif name == "exact dedup":
            want = {sha: keep for _, keep, _, sha in test_exact_dedup.brute([(d, t) for d, t, _ in before])}
            assert sorted((r.doc_id for r in rows), key=str) == sorted(want.values(), key=str)
        elif name.startswith("n-gram"):
            found = test_jaccard_join.brute([(i, t) for i, (_, t, _) in enumerate(sorted(before, key=lambda r: (r[0] is None, r[0] or 0)))])
            assert len(rows) == len({c for _, _, c in found})
        elif name.startswith("mixing"):
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            total, mixed = sum(count(t) for _, t, _ in before), sum(count(r.text) for r in rows)
            assert abs(mixed - 1.5 * total) <= 5
            whole = {d: t for d, t, _ in before}
            assert all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in rows if r.doc_id not in (None, 3001) and r.text != whole[r.doc_id])
        else:
            with open(vocabulary_path(), "rb") as f:
                model = ForcedBoundaryBPE(f.read())
            want = sorted(((d, len(model.encode(t or "")[0]) // 4) for d, t, _ in before), key=str)
            assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=str) == want
        docs = after


def test_run(spark, tables):
    path, _ = tables
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 200
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
