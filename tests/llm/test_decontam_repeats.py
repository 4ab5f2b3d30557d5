"""Repetitive texts and equal items."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from fanscope.llm import decontam as D


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("hits", [40, 1 << 20])
def test_best_of_all_diagonals(monkeypatch, seed, hits):
    """Against best_run() on each diagonal, on few different tokens, so that diagonals are much alike."""
    monkeypatch.setattr(D, "HITS", hits)
    rng = np.random.default_rng(seed)
    for _ in range(60):
        item = rng.integers(0, 2 + seed, rng.integers(1, 40)).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 2 + seed, rng.integers(0, 60)), item[:rng.integers(0, len(item) + 1)].astype(int),
                              rng.integers(0, 2 + seed, rng.integers(1, 30))]).astype(np.uint64)
        diagonals = np.unique(rng.integers(-len(item) + 1, len(doc), 25))
        runs = [x for d in diagonals.tolist() if (x := D.best_run(doc, item, d))]
        assert D.best_of(doc, item, diagonals) == (max(runs, key=lambda x: x[3]) if runs else None)


@pytest.mark.parametrize("hits", [7, 1 << 20])
def test_hits_in_parts_are_the_same(monkeypatch, hits):
    texts = ["the cat sat on the mat " * 6, "a b c d e f g h i j k l m n", None, "x y"]
    bench = D.Bench([1, 2, 3, 4, 5], ["the cat sat on the mat " * 3, "A b c d e f g h i j k l m", "", "the cat sat on the mat " * 3, "x y"])
    h, rows = D.tokens(pa.array(texts, pa.string()))
    want = bench.leaks(h, rows)
    monkeypatch.setattr(D, "HITS", hits)
    got = bench.leaks(h, rows)
    assert got == want and {k for k in want} == {(0, 0), (0, 3), (1, 1), (3, 4)} and want[0, 0] == want[0, 3] == (0, 0, 18, 18, 18)


def test_repetitive_text_against_equal_items_is_fast():
    bench = D.Bench(list(range(200)), ["the cat " * 30] * 200)
    for n in (2000, 100_000):
        h, rows = D.tokens(pa.array(["the cat " * n]))
        began = time.process_time()
        found = bench.leaks(h, rows)
        took = time.process_time() - began
        assert len(found) == 200 and all(x[3] == 60 for x in found.values())
        assert took < (3 if n == 2000 else 60)
