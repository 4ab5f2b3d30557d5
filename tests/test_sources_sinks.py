"""Raw TSV and topic JSON sources, sinks and fingerprinted checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from conftest import make_tables, rows, small_params

from fanscope import sinks
from fanscope.plans.pipeline import AffinityPipeline
from fanscope.plans.reports import run_reports
from fanscope.sources import topic_json, tsv


def _write(folder: str, name: str, lines: list[str]) -> str:
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


def test_tsv_guard_positions_and_nulls(spark):  # D10
    d = tempfile.mkdtemp(prefix="fanscope-test-")
    info = _write(d, "person_info", [
        "\t".join(["p9"] + ["x"] * 8),                       # 9 fields: no gender/locale field
        "\t".join(["p12", "a", "b", "c", "d", "01/02/1990", "e", "f", "single", "g", "male", "h"]),
        "\t".join(["p16"] + ["null"] * 4 + ["07/04/1976"] + ["y"] * 2 + ["married", "z", "female"]
                  + ["w"] * 4 + ["en_US"]),
        "\t".join(["p_short", "a", "b"]),                     # ragged: skipped
        "\t".join(["p_tabs"] + ["v"] * 6 + [""] * 9) + "\t\t",  # trailing empties do not count
    ])
    got = {r.person_id: r for r in tsv.read_person_info(spark, info).collect()}
    assert set(got) == {"p9", "p12", "p16"}
    assert got["p9"].gender_raw is None and got["p9"].locale_raw is None
    assert got["p12"].birthday_raw == "01/02/1990" and got["p12"].gender_raw == "male"
    assert got["p12"].locale_raw is None
    assert got["p16"].locale_raw == "en_US" and got["p16"].gender_raw == "female"


def test_tsv_facts_and_locations(spark):
    d = tempfile.mkdtemp(prefix="fanscope-test-")
    facts = _write(d, "fact_like", ["f1\tp1\tl1", "f1\tp1\tl1", "f2\tp1", "f3\tp2\tl2\textra"])
    df = tsv.read_fact_like(spark, facts)
    assert rows(df) == [("f1", "p1", "l1"), ("f1", "p1", "l1"), ("f3", "p2", "l2")]
    locs = _write(d, "dim_location", ["L1\ta\tb\tc\td\te\tIndia\tDelhi",
                                      "L2\ta\tb\tc\td\te\tIndia\tnull",
                                      "L3\ta\tb\tc\td\te\tIndia",
                                      "L4\ta\tb\tc\td\te"])
    got = rows(tsv.read_dim_location(spark, locs))
    assert got == [("L1", "India", "Delhi"), ("L2", "India", None), ("L3", "India", None)]


def test_topic_json_round_trip(spark):  # D1
    d = tempfile.mkdtemp(prefix="fanscope-test-")
    ents = spark.createDataFrame([("7", 'say "hi", ok', "Song"), ("8", "b", None)],
                                 "like_id string, name string, type string")
    sinks.write_topic_file(ents, os.path.join(d, "topic"))
    back = topic_json.read_topic_lines(spark, os.path.join(d, "topic"))
    assert rows(back) == rows(ents)
    arr = _write(d, "topic.json", ['[["153", ["red plate", "PROMO"]], ["154", ["x", "y"]], '
                                   '["153", ["red plate", "PROMO"]]]'])
    got = topic_json.read_topic_array(spark, arr, "bigint")
    assert rows(got.distinct()) == [(153, "red plate", "PROMO"), (154, "x", "y")]


def test_empty_topic_is_allowed(spark):  # D2
    t = make_tables(spark, [("f1", "P1", "B1"), ("f2", "P2", "B1")], [("B1", "b", "x")], ["P1", "P2"],
                    topic=[])
    p = AffinityPipeline(t, small_params())
    assert p.n_topic == 0
    assert rows(p.person_topic_share, "share") == [(0.0,), (0.0,)]


def test_checkpoint_store_reuses_and_misses(spark):  # D17
    facts = [("f1", "P1", "T1"), ("f2", "P1", "B1"), ("f3", "P2", "B1")]
    ents = [("T1", "t", "x"), ("B1", "b", "x")]
    t = make_tables(spark, facts, ents, ["P1", "P2"], topic=[("T1", "t", "x")])
    a = AffinityPipeline(t, small_params(), store="checkpoint")
    first = rows(a.entity_implications)
    kept = os.listdir(a.checkpoint_prefix.replace("file:", ""))
    assert any(name.startswith("entity_implications-") for name in kept)
    b = AffinityPipeline(t, small_params(), store="checkpoint")
    assert b.checkpoint_prefix == a.checkpoint_prefix
    assert rows(b.entity_implications) == first
    c = AffinityPipeline(t, small_params(exponent=0.5), store="checkpoint")
    assert c.checkpoint_prefix != a.checkpoint_prefix


def test_materialize_recomputes_without_success_marker(spark):
    d = tempfile.mkdtemp(prefix="fanscope-test-")
    path = os.path.join(d, "m")
    os.makedirs(path)                       # a failed attempt: folder, no _SUCCESS
    df = spark.range(5).select(F.col("id").alias("x"))
    assert sorted(r.x for r in sinks.materialize(df, path).collect()) == [0, 1, 2, 3, 4]
    assert os.path.exists(os.path.join(path, "_SUCCESS"))


def test_run_reports_writes_everything(spark):
    facts = [("f1", "P1", "T1"), ("f2", "P1", "B1"), ("f3", "P2", "B1"), ("f4", "P2", "B2"),
             ("f5", "P3", "B2")]
    ents = [("T1", "t", "Song"), ("B1", "b", "Band"), ("B2", "c", "Band")]
    profiles = [("P1", "01/02/1990", "single", "male", "en_US"),
                ("P2", "03/04/1980", "engaged (Pending)", "female", "hi_IN"),
                ("P3", None, None, None, None)]
    t = make_tables(spark, facts, ents, ["P1", "P2", "P3"], topic=[("T1", "t", "Song")],
                    profiles=profiles, categories={"music": ["Song"]}, names=["B"])
    out = tempfile.mkdtemp(prefix="fanscope-reports-")
    written = run_reports(AffinityPipeline(t, small_params()), out)
    for path in written:
        assert os.path.exists(os.path.join(path, "_SUCCESS")), path
    # T1 has one liker, so it is not big and has no implication (D16).
    top = spark.read.json(os.path.join(out, "top_implications")).collect()
    assert [r.like_id for r in top] == ["B1", "B2"]


def test_cli_on_raw_tsv_inputs(spark):
    """The hand-worked example as raw TSV folders and a topic JSON array."""
    from fanscope.__main__ import main

    root = tempfile.mkdtemp(prefix="fanscope-raw-")
    for name in ("fact_like", "dim_like", "fact_location", "dim_location", "person_info"):
        os.makedirs(os.path.join(root, name))
    facts = [("f1", "P1", "T1"), ("f2", "P1", "B1"), ("f3", "P2", "B1"), ("f4", "P2", "B2"),
             ("f5", "P3", "B2"), ("f6", "P3", "B1"), ("f7", "P4", "T1"), ("f8", "P5", "B1"),
             ("f9", "P1", "B1")]
    _write(os.path.join(root, "fact_like"), "part-0", ["\t".join(f) for f in facts])
    _write(os.path.join(root, "dim_like"), "part-0",
           ["T1\ttopic one\tShow\tx1", "B1\tbig one\tBand\tx2", "B2\tbig two\tBand\tx3"])
    _write(os.path.join(root, "fact_location"), "part-0",
           [f"r{i}\t{p}\t{loc}" for i, (p, loc) in
            enumerate([("P1", "L1"), ("P2", "L1"), ("P3", "L1"), ("P4", "L1"), ("P5", "L2")])])
    _write(os.path.join(root, "dim_location"), "part-0",
           ["L1\ta\tb\tc\td\te\tIndia\tDelhi", "L2\ta\tb\tc\td\te\tNepal\tnull"])
    _write(os.path.join(root, "person_info"), "part-0",
           ["\t".join([p] + ["null"] * 15) for p in ("P1", "P2", "P3", "P4", "P5")])
    topic = _write(root, "topic.json", ['[["T1", ["topic one", "Show"]]]'])
    out = tempfile.mkdtemp(prefix="fanscope-cli-")
    main(["--data-root", root, "--topic", topic, "--out", out, "--region", "India",
          "--big-min-exclusive", "1", "--top-offtopic", "1",
          "--as-of", "2016-06-01"])
    nonfans = sorted(r.person_id for r in spark.read.parquet(os.path.join(out, "edge_nonfans")).collect())
    assert nonfans == ["P2", "P3"]
    top = [(r.like_id, round(r.score, 6)) for r in spark.read.json(os.path.join(out, "top_implications")).collect()]
    assert top == [("T1", 0.820763), ("B1", 0.252619), ("B2", 0.0)]


def test_checkpoint_store_matches_memory_store_on_fixtures(spark):
    """Every registered query gives the same rows when the shared
    intermediates go through parquet checkpoints."""
    from conftest import TESTDATA
    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.queries import BUILDERS, build
    from fanscope.sources.fixtures import load_fixture_tables

    sf = os.path.join(TESTDATA, "sf0.001")
    if not os.path.isdir(sf):
        return
    t = load_fixture_tables(spark, sf, FIXTURE_PARAMS)
    ck = AffinityPipeline(t, FIXTURE_PARAMS, store="checkpoint")
    mem = AffinityPipeline(t, FIXTURE_PARAMS, store="memory")
    try:
        for name in BUILDERS:
            assert rows(build(ck, name)) == rows(build(mem, name)), name
        again = AffinityPipeline(load_fixture_tables(spark, sf, FIXTURE_PARAMS), FIXTURE_PARAMS,
                                 store="checkpoint")
        assert again.checkpoint_prefix == ck.checkpoint_prefix
    finally:
        mem.unpersist()
