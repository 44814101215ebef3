"""A meeting's forest: the nearest pairs first."""

from __future__ import annotations

import numpy as np

from brindle.llm import jaccard as J


def _star(copies: int, seed: int = 5) -> tuple[J._Meeting, int]:
    """Copies of one text, each with a tenth of its n-grams replaced; the text stands last. Each
    links with the text (0.82) and none with another (0.68), which sketches can't exclude."""
    draw = np.random.RandomState(seed)
    text = draw.randint(0, 2**62, 1000).astype(np.uint64)
    sets = [np.unique(np.concatenate((np.delete(text, draw.choice(1000, 100, replace=False)), draw.randint(0, 2**62, 100).astype(np.uint64)))) for _ in range(copies)] + [np.unique(text)]
    key = np.arange(copies + 1, dtype=np.int64)
    return J._Meeting(key, key, np.array([len(s) for s in sets]), None, [J.bit_sketch(s) for s in sets]), copies


def test_copies_meet_their_text_first():
    meeting, text = _star(30)
    assert len(meeting.pairs(False)) > 300
    found = meeting.pairs(True)
    assert sorted(found) == [(i, text) for i in range(text)]


def test_forest_joins_what_sketches_allow_and_no_component_twice():
    """As many pairs as components are joined by sketches, none inside a component, both
    in one block and across two."""
    for mine in (None, np.arange(31) % 2):
        meeting, text = _star(30)
        meeting.mine = mine
        meeting.component = np.where(np.arange(31) < 10, 0, np.arange(31))
        group = meeting.component.copy()
        for a, b in meeting.pairs(True):
            assert group[a] != group[b]
            assert mine is None or mine[a] != mine[b]
            group[group == group[b]] = group[a]
        assert len(set(group.tolist())) == 1
