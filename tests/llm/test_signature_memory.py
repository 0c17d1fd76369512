"""What a task needs for signatures is bounded by runs of texts, however short and many the texts of a batch are, and the runs change no signature."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("gaugeline.llm")

import pyarrow as pa  # noqa: E402

from gaugeline.llm import near_dup  # noqa: E402
from gaugeline.llm.bytes import pieces  # noqa: E402


def sets(n, size):
    size = np.full(n, size) if np.isscalar(size) else size
    offsets = np.concatenate([[0], np.cumsum(size)])
    return np.random.default_rng(3).integers(0, 1 << 63, offsets[-1]).astype(np.uint64), offsets


def test_many_short_texts_need_little_memory():
    elements, offsets = sets(3000, 40)
    tracemalloc.start()
    near_dup.dart_signatures(elements, None, offsets, 280)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


@pytest.mark.parametrize("weighted", [False, True])
def test_runs_change_no_signature(monkeypatch, weighted):
    elements, offsets = sets(60, np.random.default_rng(4).integers(0, 90, 60))
    weights = np.random.default_rng(5).integers(1, 5, len(elements)).astype(float) if weighted else None
    whole = near_dup.dart_signatures(elements, weights, offsets, 40)
    for darts in (1, 700):
        monkeypatch.setattr(near_dup, "DARTS", darts, raising=False)
        assert (near_dup.dart_signatures(elements, weights, offsets, 40) == whole).all()
    assert near_dup.dart_signatures(elements[:0], None, np.zeros(1, int), 40).shape == (0, 40)


def test_pieces_hold_whole_rows_of_about_a_megabyte():
    texts = ["x" * 1000] * 5000 + ["y" * 3_000_000, "", None]
    found = list(pieces(iter([pa.RecordBatch.from_pydict({"text": texts})]), "text"))
    assert [t for p in found for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 20 for p in found)
