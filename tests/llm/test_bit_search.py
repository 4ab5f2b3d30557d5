from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fanscope.llm import bit_search as B

SCHEMA = "vec_id long, embedding array<float>, label int, q string, id long, vector array<int>, pair long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5, [1], 7) for i, v in rows], SCHEMA)


def usable(i, v):
    return i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows, k=20, query_every=20):
    seen = {}
    for i, v in rows:
        if usable(i, v):
            v = tuple(float(np.float32(c)) + 0.0 for c in v)
            seen[i] = min(seen.get(i, v), v)
    out = {}
    for i, v in seen.items():
        if i % query_every == 0:
            found = sorted((-math.fsum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in seen.items() if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def check(spark, rows, **of):
    got = B.nearest(table(spark, rows), **of)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        near = by.setdefault(r.query_id, [])
        near.append((r.vec_id, r.score))
        assert r["rank"] == len(near)
    want = {i: near for i, near in brute(rows, **of).items() if near}
    assert by.keys() == want.keys()
    for i, near in want.items():
        assert [j for j, _ in by[i]] == [j for j, _ in near]
        assert [s for _, s in by[i]] == pytest.approx([s for _, s in near], abs=1e-12)


def vectors(n, dims, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(n, dims)).astype(np.float32) * scale + 0.1)]


@pytest.mark.parametrize(("n", "dims"), [(700, 16), (15, 3), (45, 1)])
def test_nearest_against_brute_force(spark, n, dims):
    check(spark, vectors(n, dims))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "ROW_BLOCK", 60)
    monkeypatch.setattr(B, "QUERY_BLOCK", 10)
    check(spark, vectors(500, 8), k=7, query_every=10)


def test_copies_and_ties(spark, monkeypatch):
    """A vector that holds a third of the rows, queries among them, spread over tasks."""
    monkeypatch.setattr(B, "HOT", 1)
    rows = vectors(200, 4)
    check(spark, rows + [(1000 + k, rows[5][1]) for k in range(400)] + [(5000 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(30)])


def test_hot_queries_are_spread(spark):
    rows = [(k, [1.0, 0.0]) for k in range(2400)] + [(5001, [0.0, 1.0])]
    got = B.nearest(table(spark, rows), query_every=1).groupBy("query_id").count().collect()
    assert len(got) == 2401 and {r["count"] for r in got} == {20}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 3)
    odd = [(None, [1.0, 2.0, 3.0]), (80, None), (100, []), (120, [0.0, -0.0, 0.0]), (140, [nan, 1.0, 1.0]), (160, [1.0, inf, 0.0]),
           (180, [1.0, None, 0.0]), rows[0], rows[20], (40, [-9.0, 0.0, 0.0]), (200, [1.0, 2.0]), (201, [3.0, 0.5]), (220, [1.0] * 9), (-20, [0.1, 0.2, 0.3])]
    check(spark, rows + odd)


def test_one_row_and_none(spark):
    assert B.nearest(table(spark, [(20, [1.0, 2.0])])).collect() == []
    assert B.nearest(table(spark, [])).collect() == []


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 48)) * rng.uniform(0.1, 3, size=(3000, 1)) + 0.2
    block = B.Block(v, np.arange(3000)[:, None], v.mean(0))
    for q in rng.normal(size=(20, 48)):
        estimate, off = block.bounds(q)
        error = (estimate - v @ q) / off * B.SIGMAS
        assert abs(error.mean()) < 0.2 and 0.5 < error.std() < 1.2 and (np.abs(error) > B.SIGMAS).mean() < 0.001


def test_few_vectors_are_reranked():
    v = np.random.default_rng(4).normal(size=(20_000, 64))
    block = B.Block(v, np.arange(20_000)[:, None], v.mean(0))
    seen = []
    block.exact = lambda q, rows: (seen.append(len(rows)), (v[rows] * q).sum(1))[1]
    hits = 0
    for q in v[:20]:
        hits += len(set(block.nearest(q, 21)[1]) & set(np.argsort(-(v @ q))[:21].tolist()))
    assert hits / (20 * 21) >= 0.99 and sum(seen) < 0.2 * 20 * 20_000


def test_sql_against_brute_force():
    rows = vectors(130, 5)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    got = {}
    for i, rank, j, _ in sorted(con.execute(B.oracle()).fetchall()):
        assert rank == len(got.setdefault(i, [])) + 1
        got[i].append(j)
    assert got == {i: [j for j, _ in near] for i, near in brute(rows).items()}
