import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphflow.llm.bpe import ForcedBoundaryBPE, encode_texts, vocabulary_path

from .messy import documents


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, "rb") as f:
        return ForcedBoundaryBPE(f.read()), library


TRICKY = ["", " ", "I'm WE'LL don't 's", "ΑΣ ΣΑΣ. İstanbul ǅ ẞ", "a<|endoftext|>B<|startoftext|> <|EndOfText|>", "é ½²³ ١٢ 漢字かな 😀👍🏽 \x00\x01", "qzjxk" * 30, "x" * 5000, "̈́ͅa", "a_b__c--!!\"'s'S", "भारत में", "ʼn ŉ 'ſ ﬀ Å K"]


def same(both, text):
    ours, library = both
    ids, decoded = ours.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library.decode(want, skip_special_tokens=False) == ours.decode(ids)


@pytest.mark.parametrize("text", TRICKY)
def test_as_the_library(both, text):
    same(both, text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(both, text):
    if not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        same(both, text)


def test_cuts_are_forced(both):
    ours, _ = both
    word = "".join(a + b for a in "qzxj" for b in "qzxj")
    pieces = ours.pieces(word)
    assert "".join(pieces) == word and len(pieces) > 1
    assert all(a[-1] + b[0] not in ours.joint for a, b in zip(pieces, pieces[1:]))


def test_table(spark, both):
    df, rows = documents(spark)
    got = encode_texts(df, vocabulary_path()).collect()
    assert len(got) == len(rows) + 1
    want = {d: both[0].encode(t or "") for d, t in rows}
    for r in got:
        if r.doc_id is not None:
            ids, decoded = want[r.doc_id]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert encode_texts(df.where("false"), vocabulary_path()).count() == 0
    assert encode_texts(df.where("doc_id = 1"), vocabulary_path(), with_ids=True).first().ids == []


def test_very_long_words_as_the_library(both):
    import random

    rng = random.Random(5)
    for word in ("".join(rng.choice("etaoinshr") for _ in range(20_000)), "ab" * 6_000, "aaaaaaab" * 2_000, "\u0915" * 3_000):
        same(both, word)


def test_a_million_letters(both):
    import random
    import time

    rng = random.Random(6)
    word = "".join(rng.choices("etaoinshrdlu", k=1_000_000))
    start = time.monotonic()
    ids, _ = both[0].encode(word)
    assert time.monotonic() - start < 60
    assert both[0].decode(ids).replace(" ", "").removesuffix("</w>") == word
