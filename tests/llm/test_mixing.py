from __future__ import annotations

import random
from collections import Counter

import pytest
from helpers import ODD, docs, words

from fanscope.llm import mixing as M


def waterfilled(sizes, weights):
    """Shares by weight; what is above 3 times a size is shared again until none is."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / total > 3 * sizes[k]}
        if not over:
            for k in free:
                target[k] = left * weights[k] / total
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
        left -= sum(target[k] for k in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice((0, 1, 10, 500, 10_000)) for _ in range(9)]
    weights = [k % 3 + 1 for k in range(9)]
    level = M.level(spark.createDataFrame(list(zip(sizes, weights, strict=True)), "size long, weight long"))
    assert [min(3 * n, level * w) for n, w in zip(sizes, weights, strict=True)] == pytest.approx(waterfilled(sizes, weights))


def rows_of(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 6) for _ in range(rng.randint(0, 400))),
             "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "ü", None])) for i in range(n)]


def test_report_against_its_contract(spark):
    rows = rows_of()
    got = M.mix_report(docs(spark, rows)).collect()
    size = {i: len(words(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    of_source = Counter()
    for i, n in size.items():
        of_source[source[i]] += n
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, waterfilled([of_source[s] for s in order], [k % 3 + 1 for k in range(len(order))]), strict=True))
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], of_source[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s]
    again = M.mix_report(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_every_prefix_of_the_schedule_is_near_the_weights(spark):
    table = M.weighted(spark.createDataFrame([(k, 10_000, t, 1000) for k, t in enumerate((2_500.0, 7_500.0, 20_000.0))],
                                             "k long, source_size long, target double, blocks long"))
    slots = sorted(M.schedule(table).collect(), key=lambda r: r.slot)
    assert len(slots) == 3000 and [r.slot for r in slots] == list(range(3000))
    seen = Counter()
    for n, r in enumerate(slots, 1):
        assert (seen[r.k] // 1000, seen[r.k] % 1000) == (r["pass"], r.block)  # ranks in order
        seen[r.k] += 1
        for k, share in enumerate((1 / 12, 1 / 4, 2 / 3)):
            assert abs(seen[k] - n * share) < 6


def test_mixed_repeats_whole_documents(spark):
    rows = rows_of()
    frame = docs(spark, rows)
    taken = {r.doc_id: r.taken / r.size for r in M.mix_report(frame).collect() if r.size}
    got = M.mixed(frame)
    assert got.columns == frame.columns
    times = Counter(r.doc_id for r in got.collect())
    assert all(abs(times[i] - share) <= 0.5 + 1e-9 for i, share in taken.items())


def test_odd_rows(spark):
    got = M.mix_report(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r.size == 0 and r.taken == 0 for r in got) == 4
    assert M.mixed(docs(spark, ODD)).columns == docs(spark, []).columns
    assert M.mix_report(docs(spark, [])).count() == 0 and M.mixed(docs(spark, [])).count() == 0
    assert {r.taken for r in M.mix_report(docs(spark, [(1, None), (2, "")])).collect()} == {0}


def test_any_number_of_sources(spark, monkeypatch):
    """Sources beyond a broadcast (small here), and far more than slots in a cell."""
    rows = rows_of(300)
    few = sorted(map(tuple, M.mix_report(docs(spark, rows)).collect()))
    monkeypatch.setattr(M, "FEW", 2)
    assert sorted(map(tuple, M.mix_report(docs(spark, rows)).collect())) == few
    monkeypatch.setattr(M, "FEW", 100)
    many = [(i, "w " * (1 + i % 5), f"site{i // 2}") for i in range(6000)] + [(9000 + i, "v " * 50, "hot") for i in range(300)]
    got = M.mix_report(docs(spark, many)).collect()
    size, target, taken = Counter(), {}, Counter()
    for r, s in ((r, many[r.doc_id][2] if r.doc_id < 9000 else "hot") for r in got):
        target[s] = r.target
        taken[s] += r.taken
        size[s] += r.size
    assert len(got) == len(many) and len(target) == 3001
    order = sorted(size)
    want = waterfilled([size[s] for s in order], [k % 3 + 1 for k in range(len(order))])
    assert [target[s] for s in order] == pytest.approx(want)
    off = [abs(taken[s] - target[s]) for s in order]
    assert max(off) <= 8 and sum(off) < 0.25 * sum(size.values()) and abs(sum(taken.values()) - sum(size.values())) < 0.02 * sum(size.values())
