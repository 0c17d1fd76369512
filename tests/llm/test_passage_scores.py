"""Which passages the decontamination aligns with their places, and the score by which it leaves the others out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("gaugeline.llm")
from gaugeline.llm import decontaminate  # noqa: E402


def test_only_passages_that_are_hits_are_aligned(monkeypatch):
    """Texts and items of the same few frequent words: nearly all passages hold enough of an item's words, few of them in order."""
    rng = random.Random(6)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60), rng.randrange(60))}"
    items = [[word() for _ in range(rng.randrange(25, 60))] for _ in range(40)]
    texts = [[word() for _ in range(300)] for _ in range(60)]
    for k in range(0, 60, 4):
        texts[k][100:100] = [x if rng.random() > 0.2 else word() for x in items[k % 40]]
    aligned, passages = [], []
    alignments, bounds = decontaminate.alignments, decontaminate.Matcher.bounds
    monkeypatch.setattr(decontaminate, "alignments", lambda i, p: aligned.extend(p) or alignments(i, p))
    monkeypatch.setattr(decontaminate.Matcher, "bounds", lambda self, hashed, item, first, end: passages.extend(item) or bounds(self, hashed, item, first, end))
    m = decontaminate.Matcher.of(list(range(40)), [" ".join(i) for i in items])
    found = m.hits(pa.array([" ".join(t) for t in texts]), 0.4)
    assert {(k, k % 40) for k in range(0, 60, 4)} <= {(t, i) for t, i, *_ in found}
    assert len(passages) > 5 * len(found) and len(aligned) <= 2 * len(found)


@pytest.mark.parametrize("longest", [30, 200, 17000])
def test_score_of_passages_is_that_of_the_alignment(longest, monkeypatch):
    """In integers of one, two and four bytes, whatever stands side by side."""
    rng = np.random.default_rng(longest)
    count = 60 if longest < 1000 else 2
    items = [" ".join(f"w{k}" for k in rng.integers(0, 8, rng.integers(1, longest))) for _ in range(count)]
    items[0] = " ".join(f"w{k}" for k in rng.integers(0, 8, longest)) if longest < 1000 else " ".join(["w1"] * longest)
    m = decontaminate.Matcher.of(list(range(count)), items)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9, rng.integers(0, 2 * longest if longest < 1000 else 40))) for _ in range(count)]
    texts[1] = items[1] if longest < 1000 else texts[1]
    hashed, before = decontaminate.words_of(pa.array(texts))
    item = rng.permutation(count)
    want = [s for s, _, _ in decontaminate.alignments([m.words[i] for i in item], [hashed[a:b] for a, b in zip(before[:-1], before[1:], strict=True)])]
    for cells in (1 << 16, 1):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        assert m.scores(hashed, item, before[:-1], before[1:]).tolist() == want
