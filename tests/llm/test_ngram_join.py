from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from helpers import ODD, TEXT, docs, shingles

from fanscope.llm import ngram_join as J


def brute(rows):
    """doc_id -> (class, links), for distinct doc_ids."""
    sets, text = {i: shingles(t) for i, t in rows}, dict(rows)
    root = {i: i for i in sets}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if (text[a] or "") == (text[b] or "") or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in sets}


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for i in range(n):
        if i % 3 or not out:
            w = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 6, 40, 120)))]
        else:  # a copy with some words changed
            w = (rng.choice(out)[1] or "x").split()
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w)))
    return out + [(n, ""), (n + 1, None), (n + 2, "  "), (n + 3, "w1  w2")]


def test_prefix_length_reaches_the_recall():
    assert J.PREFIX == 4
    for length in (1, 2, 3, 5):
        recall = 1 - (1 - 0.8 ** length) ** 16
        assert J.prefix_length(0.8, 16, 8, recall) == length
    assert J.prefix_length(0.5, 1, 6, 0.99) == 1


@pytest.mark.parametrize("block, node_rows", [(1 << 20, 1024), (600, 2)])
def test_against_brute_force(spark, monkeypatch, block, node_rows):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "NODE_ROWS", node_rows)
    rows = corpus(240)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.document_classes(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_a_large_group_of_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 5000)
    monkeypatch.setattr(J, "NODE_ROWS", 16)
    rng = random.Random(1)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.document_classes(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = J.document_classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    sizes = defaultdict(list)
    for r in got:
        sizes[r.doc_id].append((r.class_id, r.n_links, r.class_size))
    assert sizes[4] == [(4, 3, 4)] * 2 and sizes[5] == [(4, 3, 4)] and (4, 3, 4) in sizes[None]
    assert sizes[1] == [(1, 2, 3)] and sizes[2] == [(1, 2, 3)] and sizes[3] == [(3, 0, 1)]
    kept = J.one_of_each_class(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 4, 6, 7, 8, 9]
    assert next(r for r in rows if r.doc_id == 4).text == TEXT
    assert J.document_classes(docs(spark, [])).count() == 0 and J.one_of_each_class(docs(spark, [])).count() == 0
