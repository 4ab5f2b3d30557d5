from __future__ import annotations

import os
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pytest
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
import corpus_pipeline
from fanscope.llm import license_scan, line_spread, queries
from fanscope.llm.license_templates import TEMPLATES

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures not present")


# --- lines
def line_rows():
    rows = [(i, f"own {i}\nshared by all \n\nshared by some {i % 2}", f"s{i % 12}") for i in range(60)]
    rows += [(100 + k, "on four sites\nx", f"t{k}") for k in range(4)] + [(110 + k, "on five sites\ny", f"t{k}" if k else None) for k in range(5)]
    return rows + [(200, "shared by all\n\tshared by all\t\n \nend", "z")]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_lines_against_sql(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_spread, "BROADCAST_LINES", broadcast)
    frame = docs(spark, line_rows() + ODD)
    got = line_spread.without_boilerplate(frame).collect()
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(line_spread.oracle()).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].clean_text == "own 0\n" and by_id[0].n_removed == 2
    assert by_id[100].clean_text == "on four sites\nx" and by_id[110].clean_text == "" and by_id[200].n_removed == 2


def test_lines_of_an_empty_table(spark):
    assert line_spread.without_boilerplate(docs(spark, [])).count() == 0


# --- licences
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_patience_is_a_common_subsequence(a, b):
    match = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in match)
    assert all(i < k and j < m for (i, j), (k, m) in zip(match, match[1:], strict=False))
    if a == b:
        assert len(match) == len(a)


@given(st.permutations(range(12)), st.permutations(range(12)))
def test_anchors_are_a_longest_increasing_subsequence(a, b):
    table = [[0] * 13 for _ in range(13)]
    for i in range(12):
        for j in range(12):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert len(license_scan._anchors(list(a), list(b))) == table[12][12]


def test_every_template_is_found_in_a_text(spark):
    rows = [(k, f"{'lorem ipsum ' * 40}\n{t.upper()}\n{'dolor sit ' * 40}") for k, t in enumerate(TEMPLATES.values())]
    rows += [(100, "All rights reserved. And again: all rights reserved"), (101, "The general public has rights, version 2 of the license.")]
    edited = TEMPLATES["mit"].replace("free of charge", "gratis").replace("publish, ", "").replace("Software is", "said Software is")
    got = license_scan.scan(docs(spark, [*rows, (102, edited), *[(None if i is None else 1000 + i, *r) for i, *r in ODD]])).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.license)
    assert {k: [n] for k, n in enumerate(TEMPLATES)} == {k: v for k, v in found.items() if k is not None and k < 100}
    assert found[100] == ["all-rights-reserved"] * 2 and found[102] == ["mit"] and set(found) == {*range(len(TEMPLATES)), 100, 102}
    by = next(r for r in got if r.doc_id == 102)
    blocks = SequenceMatcher(None, *[[w.strip(".,;:()\"/").lower() for w in t.split()] for t in (edited, TEMPLATES["mit"])], autojunk=False)
    assert by.n_matched >= sum(b.size for b in blocks.get_matching_blocks()) and 0.9 < by.coverage < 1
    assert license_scan.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [2, 3, 40])
def test_every_copy_of_a_licence_is_found(copies):
    table = license_scan.Templates(TEMPLATES)
    for name, notice in TEMPLATES.items():
        for between in ("", "foo", "foo bar", "lorem ipsum dolor sit amet " * 6):
            column = pa.array([f"x y z {f' {between} '.join([notice] * copies)} w v u"])
            got = table.finds(*license_scan.tokens(column))
            assert [table.names[f[1]] for f in got] == [name] * copies, (name, between)
            size, apart = len(table.words[got[0][1]]), len(between.split())
            assert [(f[2], f[4]) for f in got] == [(3 + k * (size + apart), size) for k in range(copies)]


def test_copies_with_edits_and_a_part_between_them():
    table = license_scan.Templates(TEMPLATES)
    whole = TEMPLATES["mit"]
    edited = whole.replace("free of charge", "gratis").replace("publish, ", "").replace("Software is", "said Software is")
    part = " ".join(whole.split()[:30])
    got = table.finds(*license_scan.tokens(pa.array([f"a b {edited} c {part} d {whole} e {edited} f"])))
    assert [table.names[f[1]] for f in got] == ["mit"] * 3 and got[1][4] == len(table.words[got[1][1]])


# --- registry and pipeline
def test_registry():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert set(queries.QUERIES) <= set(E.queries()) and set(queries.ORACLE_SQL) <= set(E.oracle_sql())


@there
def test_pipeline(spark):
    from fanscope.llm.common import written
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, label = frame.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen, stage_rows = {r.doc_id for r in frame.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, SF), "test-stage")
        assert frame.columns == columns, name
        ids = [r.doc_id for r in frame.collect()]
        assert set(ids) <= seen
        if name == "quality":
            clean = {i for i in seen if i in label and label[i].quality == 1}
            assert len(clean & set(ids)) >= 0.97 * len(clean)
        if name != "mix":
            assert len(ids) == len(set(ids))
        seen = set(ids)
        stage_rows.append(len(ids))
    assert stage_rows[0] > stage_rows[1] >= stage_rows[2]
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == stage_rows[3]
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_pipeline_of_odd_rows(spark):
    frame = docs(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        frame.count()
    empty = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
