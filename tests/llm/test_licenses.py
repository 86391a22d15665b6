import re

from glyphflow.llm.licenses import BASE, OWN, scan_licenses

from .messy import documents

TEXTS = [
    None, "", "...", "CC-BY, cc by; ccby CC  BY", "All rights\nreserved. all rights not reserved", "GNU General Public License and general public licenses", "cc", "by cc by cc by",
    "Licensed under the Apache License, Version 2.0", "Released, gladly, under the MIT license.", "ärights all rights reserved", "c" * 5000 + " cc by " + "x " * 5000, "CC BY K all Rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted",
]


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = [(i, label) for label, phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, pos int, w string").repartition(2)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[8].labels == "apache-2.0" and got[9].labels == "mit" and got[13].labels == "mit" and got[14].labels == ""
    assert all(set(r.base_labels.split(",")) <= {"", *r.labels.split(",")} and 0 <= r.score <= 1 for r in got.values())
    assert got[1].score == 0 and got[13].score == 1 and 0 < got[14].score < 0.75


def whole(label):
    return max((t for x, t in OWN if x == label), key=len).split()


def test_whole_licenses_altered_and_interleaved(spark):
    texts = {}
    opening = 16  # words that may be a template of their own
    for label in ("mit", "bsd", "apache-2.0", "gpl-3.0"):
        w = whole(label)
        opening = 16  # without its opening, which is a template of its own
        texts[label, "copy"] = "Some words. " + " ".join(w).upper() + " and others"
        texts[label, "altered"] = " ".join("changed" if i % (8 if i < opening else 15) == 3 else x for i, x in enumerate(w))
        texts[label, "lines"] = " ".join(f"{x}\n{i // 12}" if i % 12 == 11 else x for i, x in enumerate(w))
        texts[label, "shuffled"] = " ".join(sorted(w))
        texts[label, "half"] = "no " + " ".join(w[opening : len(w) // 2])
    keys = list(texts)
    got = {keys[r.doc_id]: r for r in scan_licenses(spark.createDataFrame([(i, texts[k]) for i, k in enumerate(keys)], "doc_id long, text string").repartition(3)).collect()}
    for label, kind in keys:
        assert (label in got[label, kind].labels.split(",")) == (kind in ("copy", "altered", "lines")), (label, kind, got[label, kind])


def test_long_text_and_repeated_ids(spark):
    long = "of the software " * 200_000 + " ".join(whole("mit")) + " and to permit" * 50_000
    rows = [(7, "cc by one"), (7, "one cc by"), (None, "all rights reserved"), (None, None), (8, long)]
    for parts in (1, 3):
        got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.labels) for r in got), key=str)
        want = [(7, 3, 1, 0, "cc-by"), (7, 3, 1, 1, "cc-by"), (None, 3, 1, 0, "reserved"), (None, 0, 0, None, ""), (8, len(long.split()), 0, None, "mit")]
        assert found == sorted(want, key=str)


def test_messy_table(spark):
    df, rows = documents(spark)
    got = scan_licenses(df).collect()
    assert len(got) == len(rows) + 1
    assert scan_licenses(df.where("false")).count() == 0
