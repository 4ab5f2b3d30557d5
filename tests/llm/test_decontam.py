from __future__ import annotations

import random
import re

import pytest
from helpers import ODD, docs

from fanscope.llm import decontam as D

RNG = random.Random(4)
WORDS = [f"w{k}" for k in range(3000)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(1, text(40)), (2, text(20)), (3, text(14)), (4, text(5)), (5, None), (6, ""), (7, text(40)), (8, "w1 w2 w3, w4 w5 w6 w7!")]


def substituted(t, places):
    w = t.split()
    for p in places:
        w[p] = "zz" + w[p]
    return " ".join(w)


def planted():
    item = dict(ITEMS)
    rows = [(100 + k, f"{text(30)} {item[k]}. {text(30)}") for k in (1, 2, 3, 4, 8)]
    rows += [(200, f"{text(9)} {item[1].upper()} {text(9)}"), (201, text(5) + " " + substituted(item[1], (7, 15, 23, 31)) + " " + text(5)),
             (202, " ".join(item[7].split()[10:24]) + " " + text(40)), (203, text(200) + " " + item[2] + " " + item[7])]
    clean = [(300 + k, text(300)) for k in range(20)]
    clean += [(400, " ".join(item[1].split()[:8]) + " " + text(50)), (401, substituted(item[4], (2,))), (402, " ".join(item[3].split()[:9]))]
    return rows, clean


def tokens(t):
    return re.findall(r"[^\x00-\x20!-/:-@\[-`{-~]+", (t or "").lower())


def brute(doc, item):
    """Best run over all diagonals, if it is a leak."""
    a, b = tokens(doc), tokens(item)
    best = 0
    need = len(b) if len(b) < D.SPAN else min(D.MATCH, -(-4 * len(b) // 5))
    for d in range(-len(b) + 1, len(a)):
        same = [a[d + j] == b[j] for j in range(max(0, -d), min(len(b), len(a) - d))]
        for i in range(len(same)):
            score = n = 0
            for s in same[i:]:
                score, n = score + (1 if s else -D.COST), n + s
                if score <= 0:
                    break
                best = max(best, n)
    return bool(b) and best >= need


@pytest.mark.parametrize("broadcast", [1 << 22, 0])
def test_planted_passages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    rows, clean = planted()
    frame = docs(spark, rows + clean)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, k1 long")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(frame, bench).collect()}
    assert set(got) == {(i, j) for i, t in rows + clean for j, u in ITEMS if brute(t, u)}
    assert {i for i, _ in got} == {i for i, _ in rows}
    r = got[203, 2]
    assert (r.doc_start, r.item_start, r.n_tokens, r.n_matched, r.coverage) == (200, 0, 20, 20, 1.0)
    assert got[201, 1].n_matched == 36 and got[202, 7].item_start == 10
    kept = D.without_leaks(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in clean]


def test_each_single_substitution_is_ignored_by_a_mask():
    for p in range(D.SPAN):
        assert any(p not in m for m in D.MASKS)


def test_masks_hit_whichever_fifth_is_substituted():
    # Fewest substitutions that no mask passes, over the last SPAN - 1 tokens (bit 0: the last; set: substituted).
    masks = [sum(1 << (D.SPAN - 1 - p) for p in m) for m in D.MASKS]
    full = (1 << (D.SPAN - 1)) - 1
    least = {0: 0}
    for n in range(1, 121):
        after = {}
        for state, cost in least.items():
            for bit in (0, 1):
                window = state << 1 | bit
                if n < D.SPAN or all(window & m for m in masks):
                    after[window & full] = min(after.get(window & full, n), cost + bit)
        least = after
        assert n < D.SPAN or min(least.values()) > n // 5, n


@pytest.mark.parametrize("broadcast", [1 << 22, 0])
def test_substituted_fifths(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    rng = random.Random(7)
    items = [(n, text(n, rng)) for n in [*range(12, 26), 40, 59]]
    rows, want = [], {}
    for n, item in items:
        sets = [range(k, n, 5) for k in range(5)] + [range(n - n // 5, n), range(n // 5)]
        sets += [rng.sample(range(n), n // 5) for _ in range(40)]
        for places in sets:
            places = sorted(places)[:n // 5]
            want[len(rows)] = (n, n - len(places))
            rows.append((len(rows), f"{text(9, rng)} {substituted(item, places)} {text(9, rng)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_matched) for r in D.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want)
    assert all(got[k][1] >= min(want[k][1], D.MATCH) for k in want)
    assert D.without_leaks(docs(spark, rows), bench).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 22, 0])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    frame = docs(spark, ODD + [(50, ITEMS[0][1]), (50, ITEMS[0][1])])
    assert [(r.doc_id, r.item_id) for r in D.leaks(frame, bench).collect()] == [(50, 1)] * 2
    assert D.without_leaks(frame, bench).count() == len(ODD)
    assert D.leaks(frame, none).count() == 0 and D.without_leaks(frame, none).count() == len(ODD) + 2
    assert D.leaks(docs(spark, []), bench).count() == 0 and D.without_leaks(docs(spark, []), bench).count() == 0
