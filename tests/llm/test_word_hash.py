"""Words whose hashes collided under a polynomial hash, and words on chunk boundaries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from brindle.llm import common as C
from brindle.llm import jaccard as J
from brindle.llm import repetition as RP
from brindle.llm import tokens as TK
from tests.llm.test_llm_operators import SCHEMA, brute_components, frame


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_thue_morse_words(n):
    a, b = thue_morse(n)
    lib = TK.encoder(TK.VOCABULARY).library
    text = f"x {a} y {b} z"
    ids, counts = TK.ByteBpe(C.vocabulary_path(TK.VOCABULARY)).encode([text.encode()])
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    one, other = J.gram_sets([f"p q r s {a} u".encode(), f"p q r s {b} u".encode()])
    assert not set(one.tolist()) & set(other.tolist())
    figures = RP.measure([f"{a} b c d e f g h z {b} b c d e f g h".encode()])
    assert figures["n_repeat_words"].tolist() == [0]


def test_thue_morse_components(spark):
    rows = []
    for n in (1024, 2048, 4096, 8192):
        a, b = thue_morse(n)
        rows += [(len(rows), f"p q r s {a} u", "en", "s", 0), (len(rows) + 1, f"p q r s {b} u", "en", "s", 0)]
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in frame(J.join_documents(spark.createDataFrame(rows, SCHEMA))).items()}
    assert got == brute_components(rows)


def test_hashes_tell_words_apart():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 40))) for _ in range(3000)})
    h, _, starts, ends, data = C.hash_words([" ".join(words).encode()])
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == words and len(set(h.tolist())) == len(words)
    assert len(set(C.hash_words([" ".join(words).encode()], key=9)[0].tolist()) & set(h.tolist())) == 0


def test_equal_words_and_ids_when_all_hashes_are_equal():
    texts = [b"aa bb aa ccccccccccccccccccccccc ccccccccccccccccccccccd aa 0123456789 0123456780"]
    h, _, starts, ends, data = C.hash_words(texts)
    ids = C.word_ids(np.zeros_like(h), starts, ends, data)
    assert ids.tolist() == [0, 1, 0, 2, 3, 0, 4, 5]


def test_store_with_colliding_pieces(monkeypatch):
    """A hash that tells nothing apart still gives the library's ids."""
    whole = TK.hash_words
    monkeypatch.setattr(TK, "hash_words", lambda texts: (whole(texts)[0] * np.uint64(0), *whole(texts)[1:]))
    bpe = TK.ByteBpe(C.vocabulary_path(TK.VOCABULARY))
    for texts in (["one two three", "two two two"], ["three", "one\ntwo"]):
        ids, counts = bpe.encode([t.encode() for t in texts])
        want = [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    assert zlib.crc32(b"") == 0
