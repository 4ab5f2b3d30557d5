from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from helpers import ODD, docs

from fanscope.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return H(*(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def climbed(leaves):
    """Levels of a tree, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([H(*a[i:i + 3]) for i in range(0, len(a), 3)])
    return levels


def path(levels, pos):
    out = []
    for level in levels[:-1]:
        at = pos // 3 * 3
        out.append((level[at:pos], level[pos + 1:at + 3]))
        pos //= 3
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars, ...). Result rows as the report has them."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = climbed([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], pos) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            x = leaf(r, r[1].replace("\n", "")) if hit else own
            for left, right in steps:
                x = H(*left, x, *right)
            root = top[-1][0]
            out.append((r[0], own, trees[s][-1][0], root, H(*(d for a, b in steps for d in a + b)), x, x == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def made(n, sources, seed=3):
    rng = random.Random(seed)
    return [(i * 7 % (n + 5), "\n".join(rng.choice(["a", "bé", "中", ""]) for _ in range(rng.randint(0, 4))),
             rng.choice(["en", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}" if rng.random() < 0.9 else None,
             rng.choice([None, 12])) for i in range(n)]


@pytest.mark.parametrize(("n", "sources", "levels"), [(1, 1, 6), (10, 4, 6), (400, 30, 6), (400, 30, 1), (120, 100, 2)])
def test_report_against_brute_force(spark, monkeypatch, n, sources, levels):
    monkeypatch.setattr(M, "LEVELS", levels)  # few levels: several phases, with few rows
    rows = made(n, sources)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ordered(M.merkle_report(df).collect()) == ordered(brute(rows))


def test_odd_rows(spark):
    df = docs(spark, ODD)
    got = M.merkle_report(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(got.collect()) == ordered(brute([tuple(r) for r in df.collect()]))


def test_empty_table(spark):
    assert M.merkle_report(docs(spark, [])).collect() == []


def test_equal_rows_part_over_tasks(spark):
    rows = [(1, "copy", "en", "s", 4)] * 500 + [(2, "other", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = M.placed(df.select("source", "doc_id"), "source", ["doc_id"]).collect()
    assert sorted(r.pos for r in placed) == list(range(501)) and {r.n for r in placed} == {501}
    assert ordered(M.merkle_report(df).collect()) == ordered(brute(rows))


def test_order_of_input_does_not_matter(spark):
    rows = made(90, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ordered(M.merkle_report(df).collect()) == ordered(M.merkle_report(df.repartition(7)).collect())


def test_any_change_is_found(spark):
    """A path proves its own leaf and no other."""
    rows = M.manifest(spark.createDataFrame(made(60, 4), "doc_id long, text string, lang string, source string, n_chars long")).collect()
    for r in rows:
        for x, good in ((r.leaf, True), (rows[0].leaf, r.leaf == rows[0].leaf), (H("other"), False)):
            for left, right in r.path:
                x = H(left, x, right)
            assert (x == r.root) == good


def test_sql_against_brute_force():
    rows = made(200, 12)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    documents = pa.table({k: pa.array([r[i] for r in rows], pa.int64() if i in (0, 4) else pa.string()) for i, k in enumerate(names)})
    con = duckdb.connect()
    con.register("documents", documents)
    assert ordered(con.execute(M.oracle()).fetchall()) == ordered(brute(rows))
