"""New pieces of op2 go to the library many at a time, and have the ids they have alone."""

from __future__ import annotations

import random

import numpy as np

from brindle.llm import tokens as T
from brindle.llm.common import vocabulary_path


def _cut(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(counts).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_few_texts_for_many_pieces(monkeypatch):
    bpe = T.ByteBpe(vocabulary_path(T.VOCABULARY))
    given = []
    whole = bpe.whole
    monkeypatch.setattr(bpe, "whole", lambda texts: given.extend(texts) or whole(texts))
    text = " ".join(f"w{i}" for i in range(2000)) + "\n" + "\n".join(f"w{i}." for i in range(2000))
    assert _cut(*bpe.encode([text.encode()])) == whole([text])
    assert len(given) < 200  # and not 4000


def test_ids_are_the_library_s():
    """White space beyond ASCII, marks and special tokens beside separators."""
    bpe, r = T.ByteBpe(vocabulary_path(T.VOCABULARY)), random.Random(3)
    parts = ["a", "foo", "Bar", "'s", "'", "\xa0", " ", "\x85", "\x1c", "é", "é", "—", ".", "$$", "12", "<|endoftext|>", "漢字", "🙂", "Ġ", "Ċ", "​"]
    for _ in range(30):
        texts = ["".join(r.choice(parts) + r.choice([" ", " ", "\n", "", "", "  ", "\t"]) for _ in range(r.randrange(30))) for _ in range(60)]
        assert _cut(*bpe.encode([t.encode() for t in texts])) == bpe.whole(texts)
