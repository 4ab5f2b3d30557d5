"""Physical plan checks: no Python evaluation, no cartesian or nested-loop
joins, no unpartitioned windows, filters and column pruning at the scan,
bounded sets broadcast."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest

from conftest import TESTDATA

import __spark_entry__ as E
from fanscope.plans.queries import registry

SF = os.path.join(TESTDATA, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures not present")

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    """Whole plans: nothing is kept, so that each goes back to the scans."""
    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.pipeline import AffinityPipeline
    from fanscope.plans.queries import build
    from fanscope.sources.fixtures import VARIANTS, load_fixture_tables

    pipes = {v: AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS, v), FIXTURE_PARAMS, store="none")
             for v in VARIANTS}
    return {name: plan_text(build(pipes[variant], result)) for name, (variant, result) in registry().items()}


def test_no_python_or_cartesian(plans):
    for name, text in plans.items():
        for op in FORBIDDEN:
            assert op not in text, f"{name} uses {op}"


def test_no_unpartitioned_window(plans):
    for name, text in plans.items():
        for spec in re.findall(r"Arguments: \[.*?\], \[(.*?)\], \[", text):
            assert spec.strip(), f"{name} has a window without partitioning"


def test_region_filter_pushed_to_scan(plans):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(r_name,ASIA\)", plans["region_people"])


def scans(text: str) -> dict[str, set[str]]:
    """file name -> ReadSchemas of its scans in a formatted plan."""
    out: dict[str, set[str]] = {}
    for m in re.finditer(r"\(\d+\) Scan parquet[^\n]*\n((?:[^\n]+\n){1,12})", text):
        loc = re.search(r"Location: [^\n]*\[([^\]]*)\]", m.group(1))
        rs = re.search(r"ReadSchema: ([^\n]*)", m.group(1))
        if loc and rs:
            out.setdefault(loc.group(1).split("/")[-1], set()).add(rs.group(1))
    return out


def test_fact_scan_reads_only_needed_columns(plans):
    got = scans(plans["top_implications"])
    # Pairs of topic entity and person are distinct as they are; they need no fact ids.
    assert got["lineitem.parquet"] == {"struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>",
                                       "struct<l_orderkey:bigint,l_partkey:bigint>"}
    assert got["orders.parquet"] == {"struct<o_orderkey:bigint,o_custkey:bigint>"}


def test_topk_is_take_ordered(plans):
    for name in ("top_implications", "top_offtopic"):
        assert "TakeOrderedAndProject" in plans[name]


def test_top_offtopic_ids_broadcast_to_facts(plans):
    # The edge likers semi-join broadcasts the k top off-topic ids.
    assert re.search(r"BroadcastHashJoin LeftSemi", plans["edge_likers"])


def test_shuffle_fallback_gives_same_results(spark):
    """With a zero broadcast bound every counted set takes the shuffle path;
    results must not change."""
    import dataclasses

    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.pipeline import AffinityPipeline
    from fanscope.plans.queries import BUILDERS, build
    from fanscope.sources.fixtures import load_fixture_tables

    # Earlier tests cached the same logical plans with broadcast joins; start
    # clean so the fallback plans are planned (and cached) here.
    spark.catalog.clearCache()
    tables = load_fixture_tables(spark, SF, FIXTURE_PARAMS)
    small = AffinityPipeline(tables, dataclasses.replace(FIXTURE_PARAMS, broadcast_max_rows=0))
    default = None
    # With AQE's runtime broadcast also off, the joins must plan as shuffles.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(build(small, "like_topic_fractions"))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        got = {name: sorted(map(tuple, build(small, name).collect()), key=repr) for name in BUILDERS}
        small.unpersist()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        default = AffinityPipeline(tables, FIXTURE_PARAMS)
        for name in BUILDERS:
            want = sorted(map(tuple, build(default, name).collect()), key=repr)
            assert got[name] == want, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        small.unpersist()
        if default is not None:
            default.unpersist()


def test_hot_person_split_gives_same_results(spark):
    """With a low hot-person share the heaviest likers are joined map-side;
    results must not change and the plan must show the split."""
    import dataclasses

    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.pipeline import AffinityPipeline
    from fanscope.plans.queries import build
    from fanscope.sources.fixtures import load_fixture_tables

    tables = load_fixture_tables(spark, SF, FIXTURE_PARAMS)
    hot = AffinityPipeline(tables, dataclasses.replace(FIXTURE_PARAMS, hot_person_share=0.3))
    cold = AffinityPipeline(tables, dataclasses.replace(FIXTURE_PARAMS, hot_person_share=100.0))
    try:
        assert hot.hot_people is not None and 0 < hot.hot_people.count() < 8 / 0.3
        assert cold.hot_people is None
        assert "LeftAnti" in plan_text(hot.like_topic_fractions)
        for name in ("like_topic_fractions", "entity_implications", "tier_implications",
                     "top_offtopic", "edge_nonfans"):
            got = sorted(map(tuple, build(hot, name).collect()), key=repr)
            want = sorted(map(tuple, build(cold, name).collect()), key=repr)
            assert got == want, name
    finally:
        hot.unpersist()
        cold.unpersist()


def test_no_sort_based_sets_in_aggregations(plans):
    for name, text in plans.items():
        assert "ObjectHashAggregate" not in text and "collect_set" not in text, name


def test_skewed_region_joins_are_spread(spark):
    """One location with half of the people and one person with a third of the
    facts: the shuffled region joins are split into slices, rows are equal."""
    from conftest import make_tables, rows, small_params
    from fanscope.plans.pipeline import AffinityPipeline

    people = [f"P{i}" for i in range(40)]
    facts = [(f"f{i}", people[0] if i % 3 == 0 else people[i % 40], f"E{i % 7}") for i in range(300)]
    ents = [(f"E{i}", f"e{i}", "x") for i in range(7)]
    made = make_tables(spark, facts, ents, people, topic=ents[:2])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = AffinityPipeline(made, small_params(broadcast_max_rows=0, skew_slices=5), store="none")
        whole = AffinityPipeline(made, small_params(), store="none")
        for frame in ("region_people", "region_facts", "region_people_states"):
            assert rows(getattr(split, frame)) == rows(getattr(whole, frame)), frame
            assert "_slice" in plan_text(getattr(split, frame)), frame
        assert rows(split.entity_implications, "like_id", "n_likers") == rows(whole.entity_implications, "like_id", "n_likers")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_set_too_large_in_bytes_is_not_broadcast(spark):
    import dataclasses

    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.pipeline import AffinityPipeline
    from fanscope.sources.fixtures import load_fixture_tables

    tables = load_fixture_tables(spark, SF, FIXTURE_PARAMS)
    pipe = AffinityPipeline(tables, dataclasses.replace(FIXTURE_PARAMS, broadcast_max_bytes=100), store="none")
    kept = pipe._topic_and_big_sized
    assert kept.bytes > 100 and not kept.fits
    assert "BroadcastHashJoin" not in plan_text(pipe.big_like_facts.hint("merge")) or not pipe._big_likes_sized.fits


def test_a_report_run_joins_facts_by_person_once(spark, tmp_path, monkeypatch):
    """The ranking and the tiers rank the same joined facts; all other results
    start from kept frames."""
    from fanscope.operators import affinity, avidity
    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.pipeline import AffinityPipeline
    from fanscope.plans.reports import run_reports
    from fanscope.sources.fixtures import load_fixture_tables

    built = []
    for module in (affinity, avidity):
        real = module.hot_split_join
        monkeypatch.setattr(module, "hot_split_join", lambda *a, real=real: built.append(1) or real(*a))
    pipe = AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS)
    try:
        run_reports(pipe, str(tmp_path))
        assert len(built) == 1
        for frame in (pipe.top_tier_implications(), pipe.topic_popularity, pipe.entity_avidity, pipe.edge_nonfans):
            assert "lineitem" not in plan_text(frame) and "InMemoryTableScan" not in plan_text(frame)
    finally:
        pipe.unpersist()


@pytest.mark.parametrize("name", ["top_implications", "factor_report", "top_tier_implications"])
def test_a_query_on_a_fresh_pipeline_gives_the_shared_ones_rows(spark, name):
    from fanscope.params import FIXTURE_PARAMS
    from fanscope.plans.pipeline import AffinityPipeline
    from fanscope.plans.queries import build
    from fanscope.sources.fixtures import load_fixture_tables

    fresh = AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS, store="none")
    got = sorted(map(tuple, build(fresh, name).collect()), key=repr)
    assert got == sorted(map(tuple, E.queries()[name](spark, SF).collect()), key=repr)
