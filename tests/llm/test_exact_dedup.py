import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphflow.llm.exact_dedup import Directory, exact_dedup

from .messy import documents, with_null_id


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(doc, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, _, doc in members]
    return sorted(out, key=str)


def test_groups_match_brute_force(spark):
    df, rows = documents(spark)
    got = exact_dedup(df, bucket_bytes=200).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(with_null_id(rows))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    df, _ = documents(spark)
    assert exact_dedup(df.where("false")).count() == 0


def test_colliding_keys_do_not_merge(spark, monkeypatch):
    import pyarrow as pa

    from glyphflow.llm import exact_dedup as m

    names = ["entry", "row", "doc_id", "key", "blob", "sha", "n_chars", "n_rows"]
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    rows = [(1, 1, 10, 5, z.compress(b"a"), "A", 1, 1), (2, 2, 11, 5, z.compress(b"b"), "B", 1, 1), (3, 3, 9, 5, z.compress(b"a"), "A", 2, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, m._PAGES.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=m._PAGES)
    out = sorted(zip(*(c.to_pylist() for b in m._resolve_chains(iter([batch])) for c in b.columns), strict=True))
    assert out == [(1, 9, 3, 5, "A"), (2, 11, 2, 1, "B"), (3, 9, 3, 5, "A")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 100), max_size=60), st.integers(1, 200))
def test_directory_covers_every_key_once(histogram, capacity):
    d = Directory(capacity).fill(histogram, 8)
    assert len(d.slots) == 1 << d.depth
    load = [0] * len(d.local)
    for k, v in histogram.items():
        load[d.slots[k >> (8 - d.depth)]] += v
    for b, total in enumerate(load):
        slots = [s for s, x in enumerate(d.slots) if x == b]
        assert slots == list(range(slots[0], slots[0] + (1 << (d.depth - d.local[b]))))
        assert total <= capacity or d.local[b] == 8


def test_null_and_repeated_ids(spark):
    rows = [(None, "a a"), (None, "b"), (3, "aa"), (3, "b "), (3, "c"), (1, "c"), (None, "dd  ")]
    for parts in (1, 3):
        got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
        assert sum(r.kept for r in got) == 4
