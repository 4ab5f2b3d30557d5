"""What keeps the analysis even at scale: heavy keys, selection without a sort,
one pass for ranking and tiers, run folders."""

from __future__ import annotations

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import make_tables, rows, small_params
from test_plans import SF, plan_text

from fanscope import sinks
from fanscope.operators import affinity, avidity, factors
from fanscope.operators.joins import Spread, heavy_keys, member_join
from fanscope.operators.selection import among_top, kth_largest
from fanscope.params import FIXTURE_PARAMS
from fanscope.plans.pipeline import FACTOR_ATTRIBUTES, AffinityPipeline
from fanscope.plans.queries import VARIANT_RESULTS, build, variant_pipeline
from fanscope.plans.reports import run_reports
from fanscope.sinks import runs
from fanscope.sources import topic_json, tsv
from fanscope.sources.fixtures import load_fixture_tables


# --- heavy keys ---------------------------------------------------------------------
def skewed_facts(spark, n=6000):
    keys = ["hot"] * (n // 3) + [f"k{i % 700}" for i in range(n - n // 3 - 50)] + ["warm"] * 49 + [None]
    return spark.createDataFrame([(f"p{i % 97}", k) for i, k in enumerate(keys)], "person_id string, like_id string").repartition(7)


def test_heavy_keys_are_those_above_their_share(spark):
    facts = skewed_facts(spark)
    assert rows(heavy_keys(facts, "like_id", 64)) == [("hot",)]
    assert rows(heavy_keys(facts, "like_id", 150)) == [("hot",), ("warm",)]
    assert heavy_keys(facts, "like_id", 2) is None
    assert heavy_keys(facts.limit(0), "like_id", 64) is None
    numbers = facts.select("person_id", F.length("like_id").cast("long").alias("like_id"))
    assert {r[0] for r in heavy_keys(numbers, "like_id", 4).collect()} <= {3, 4}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("hot", [True, False])
def test_spread_joins_give_the_rows_of_a_plain_join(spark, how, hot):
    facts = skewed_facts(spark)
    keyed = spark.createDataFrame([(k, n) for n, k in enumerate(["hot", "k1", "k2", "none", "warm"])], "like_id string, w int")
    spread = Spread(heavy_keys(facts, "like_id", 64) if hot else None, 5)
    got = member_join(facts, keyed, "like_id", "person_id", spread, how)
    want = facts.join(keyed, "like_id", how).select(*got.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_keys_repeated_for_slices_are_shuffled_however_small_they_look(spark, tmp_path, how):
    """Spark sees the size of the keys' file, not that of the repeated rows, so it would broadcast them."""
    spark.range(50).select(F.col("id").alias("like_id")).write.parquet(f"{tmp_path}/keyed")
    facts = spark.range(300).select(F.col("id").alias("person_id"), (F.col("id") % 70).alias("like_id"))
    text = plan_text(member_join(facts, spark.read.parquet(f"{tmp_path}/keyed"), "like_id", "person_id", Spread(None, 16), how))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_beyond_the_bounds_no_join_of_facts_by_entity_lacks_a_slice(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = load_fixture_tables(spark, SF, FIXTURE_PARAMS)
        pipe = variant_pipeline(tables, FIXTURE_PARAMS, "spread")
        pipe.store = "none"
        assert pipe.heavy_entities is not None
        for frame in (pipe.person_summary, pipe.topic_like_facts, pipe.big_like_facts, pipe.edge_likers, pipe.person_avidity):
            text = plan_text(frame)
            shuffled = re.findall(r"\(\d+\) SortMergeJoin[^\n]*\nLeft keys \[\d+\]: \[(.*?)\]\nRight keys", text)
            # Entities meet entities by id alone; wherever facts are on the left, the slice is a key.
            spread = [k for k in shuffled if "_slice" in k]
            assert spread and "BroadcastHashJoin" in text, shuffled
            exchanged = re.findall(r"hashpartitioning\((l_partkey#\d+|like_id#\d+)L?, \d+\)", text)
            assert len(spread) >= 1 and exchanged is not None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_variant_takes_every_path(spark):
    """The registered "spread" queries run the forms that they are there for."""
    pipe = variant_pipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS, "spread")
    plain = AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS)
    try:
        assert pipe.heavy_entities is not None and pipe.hot_people is not None and pipe.p.direct_top_max == 0
        for sized in (pipe._country_locations, pipe._region_people_sized, pipe._big_likes_sized, pipe._entity_rows_sized):
            assert not sized.fits
        for name in VARIANT_RESULTS["spread"]:
            assert rows(build(pipe, name)) == rows(build(plain, name)), name
    finally:
        pipe.unpersist()
        plain.unpersist()


def test_sizes_leave_names_out(spark):
    """An entity's name doesn't count where only its id and a number travel."""
    facts = [(f"f{i}", f"P{i % 3}", f"E{i % 2}") for i in range(12)]
    ents = [("E0", "x" * 5000, "t"), ("E1", "y" * 5000, "t")]
    pipe = AffinityPipeline(make_tables(spark, facts, ents, ["P0", "P1", "P2"], topic=ents[:1]),
                            small_params(broadcast_max_bytes=1000), store="none")
    assert not pipe._topic_and_big_sized.fits and pipe._entity_rows_sized.fits


# --- selection ----------------------------------------------------------------------
@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_kth_largest_against_sorting(spark, seed, text):
    rng = random.Random(seed)
    n = 400
    keys = rng.sample(range(-500, 10_000), n)
    made = [(rng.choice([0, 3, 3, 3, 10 ** rng.randint(0, 12)]), f"{'éa' if k % 3 else 'a'}{k}" if text else k) for k in keys]
    df = spark.createDataFrame(made, f"v long, t {'string' if text else 'long'}").cache()
    order = sorted(made, key=lambda r: (-r[0], r[1]))
    for k in (1, 7, 150, 399, 400, 500):
        for direct in (0, 50):
            cut = kth_largest(df, "v", "t", k, direct)
            assert (cut is None) == (k >= n)
            assert sorted(map(tuple, df.filter(among_top(cut, "v", "t")).collect())) == sorted(order[:k]), (k, direct)
    df.unpersist()


def test_kth_of_texts_that_begin_alike(spark):
    names = ["", "a", "aa", "ab", "b", "aaa", "aab", "z"]
    df = spark.createDataFrame([(1, t) for t in names], "v long, t string")
    for k in range(1, 8):
        cut = kth_largest(df, "v", "t", k, 1)
        assert sorted(r.t for r in df.filter(among_top(cut, "v", "t")).collect()) == sorted(names)[:k]


def test_popularity_of_topic_entities_that_the_entity_table_lacks(spark):
    """A: in the table. Z: in the topic file alone; only likers with another relevant like count."""
    facts = [("f1", "P1", "A"), ("f2", "P2", "A"), ("f3", "P1", "Z"), ("f4", "P3", "Z"), ("f5", "P3", "Z"), ("f6", "P2", "Z")]
    t = make_tables(spark, facts, [("A", "a", "x"), ("B", "b", "x")], ["P1", "P2", "P3"], topic=[("A", "a", "x"), ("Z", "z", "x")])
    for params in (small_params(), small_params(broadcast_max_bytes=0)):
        pipe = AffinityPipeline(t, params, store="none")
        want = rows(pipe.like_topic_stats.select("like_id", "n_likers").join(pipe.topic_ids, "like_id", "left_semi"))
        assert rows(pipe.topic_popularity) == want == [("A", 2), ("Z", 2)]


# --- one pass -----------------------------------------------------------------------
def test_ranking_is_the_same_with_and_without_the_tiers_pass(spark):
    tables = load_fixture_tables(spark, SF, FIXTURE_PARAMS)
    first, second = AffinityPipeline(tables, FIXTURE_PARAMS), AffinityPipeline(tables, FIXTURE_PARAMS)
    try:
        assert second.tier_like_stats.count()
        for name in ("like_topic_sum", "like_topic_count", "entity_implications", "top_offtopic", "edge_nonfans"):
            assert rows(build(first, name)) == rows(build(second, name)), name
        assert "tier_like_stats" not in first.__dict__
    finally:
        first.unpersist()
        second.unpersist()


def test_factor_reports_in_one_pass(spark):
    pipe = AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS)
    try:
        for attr, prop in FACTOR_ATTRIBUTES.items():
            alone = factors.factor_report(pipe.person_metrics(), getattr(pipe, prop), attr)
            of_all = pipe.factor_report_of(attr)
            assert of_all.columns == alone.columns and of_all.schema[attr].dataType == alone.schema[attr].dataType
            assert [r[:6] for r in rows(of_all)] == [r[:6] for r in rows(alone)]
        text = plan_text(factors.factor_reports(pipe.person_metrics(), pipe._factors))
        assert len(re.findall(r"\(\d+\) Union", text)) >= 1 and "attribute" in text
    finally:
        pipe.unpersist()


# --- run folders --------------------------------------------------------------------
def kept_runs(spark) -> set[str]:
    root = runs.runs_root(spark).replace("file:", "")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_run_releases_its_folder(spark):
    before = kept_runs(spark)
    with pytest.raises(RuntimeError, match="stop"):
        with runs.run_folder(spark, "test") as folder:
            kept = folder.keep(spark.range(5), "five")
            assert kept.count() == 5 and kept_runs(spark) - before
            told = json.loads(runs.read_text(spark, f"{folder.path}/{runs.MANIFEST}"))
            assert told["tables"] == ["five"] and told["kind"] == "test"
            raise RuntimeError("stop")
    assert kept_runs(spark) == before
    folder.release()  # again does nothing


def test_folders_of_dead_runs_are_cleared_and_live_ones_are_not(spark):
    dead, alive = runs.RunFolder(spark, "dead", lease_s=1000), runs.RunFolder(spark, "alive", lease_s=1000)
    dead.keep(spark.range(3), "t")
    mark = f"{dead.path}/{runs.MANIFEST}".replace("file:", "")
    os.utime(mark, (1, 1))  # last sign of life long ago
    gone = runs.clear_dead(spark)
    assert [g for g in gone if g.startswith("dead-")] == [dead.path.rsplit("/", 1)[1]]
    assert not os.path.exists(dead.path.replace("file:", "")) and os.path.exists(alive.path.replace("file:", ""))
    assert runs.clear_dead(spark, now=10.0) == []
    alive.release()


def test_heartbeat_renews_the_lease(spark):
    import time

    folder = runs.RunFolder(spark, "beat", lease_s=0.8)
    mark = f"{folder.path}/{runs.MANIFEST}".replace("file:", "")
    os.utime(mark, (1, 1))
    for _ in range(50):
        if os.path.getmtime(mark) > 1:
            break
        time.sleep(0.1)
    assert os.path.getmtime(mark) > 1
    folder.release()


def test_a_report_run_leaves_reports_only(spark, tmp_path):
    before = kept_runs(spark)
    pipe = AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS)
    run_reports(pipe, str(tmp_path))
    assert kept_runs(spark) - before
    pipe.unpersist()
    assert kept_runs(spark) == before


def test_a_table_is_written_unless_it_is_current(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_unless_current(spark.range(3), path, "a")
    assert not sinks.write_unless_current(spark.range(9), path, "a")
    assert spark.read.parquet(path).count() == 3
    assert sinks.write_unless_current(spark.range(9), path, "b")
    assert spark.read.parquet(path).count() == 9
    os.remove(os.path.join(path, "_fingerprint"))  # as after a write that failed
    assert sinks.write_unless_current(spark.range(4), path, "b")
    assert spark.read.parquet(path).count() == 4


# --- raw scans ----------------------------------------------------------------------
def test_raw_scans_read_only_the_fields_that_are_asked_for(spark, tmp_path):
    (tmp_path / "loc").mkdir()
    (tmp_path / "loc" / "a").write_text('L1\ta\tb\tc\td\te\tIn"dia\tDelhi\nL2\ta\tb\tc\td\te\n\nL3\ta\tb\tc\td\te\t\t\tx\n')
    df = tsv.read_dim_location(spark, str(tmp_path / "loc"))
    assert rows(df) == [("L1", 'In"dia', "Delhi"), ("L3", None, None)]
    schema = re.search(r"ReadSchema: (\S+)", plan_text(df)).group(1)
    assert "c0:string" in schema and "c6:string" in schema
    for unread in ("c1:", "c2:", "c3:", "c4:", "c5:"):
        assert unread not in schema


# --- bucketed by person ---------------------------------------------------------------
def test_bucketed_frames_by_person_need_no_exchange(spark):
    """Neither the grades of people nor the cold side of the ranking shuffle facts by person; the
    heaviest people are in a table of their own; rows are those of the plain pipeline."""
    tables = load_fixture_tables(spark, SF, FIXTURE_PARAMS)
    pipe, plain = variant_pipeline(tables, FIXTURE_PARAMS, "bucketed"), AffinityPipeline(tables, FIXTURE_PARAMS)
    before = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        facts = pipe._facts_by_person
        assert facts.hot is not None and 0 < facts.hot.select("person_id").distinct().count() < 200
        weights = pipe._weights
        graded = facts.then(lambda df: avidity.person_avidity(df, weights.df, pipe.p)).cold
        share = pipe._summary_by_person.then(affinity.person_topic_share)
        ranked = pipe._big_by_person.join(share).cold
        for frame in (graded, ranked, affinity.person_summary_by_pairs(facts.cold, pipe._sized(
                affinity.entity_flags(pipe._entity_rows_sized.df, pipe.topic_ids), "flags").df)):
            text = plan_text(frame)
            assert "Bucketed: true" in text and not re.search(r"hashpartitioning\(person_id", text), text
        for name in VARIANT_RESULTS["bucketed"]:
            assert rows(build(pipe, name)) == rows(build(plain, name)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        pipe.unpersist()
        plain.unpersist()
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_a_person_with_a_third_of_all_likes_is_not_in_a_bucket(spark):
    facts = [(f"f{i}", "P0" if i % 3 == 0 else f"P{i % 40}", f"E{i % 7}") for i in range(600)]
    ents = [(f"E{i}", f"e{i}", "x") for i in range(7)]
    t = make_tables(spark, facts, ents, [f"P{i}" for i in range(40)], topic=ents[:2])
    pipe, plain = AffinityPipeline(t, small_params(person_buckets=4, heavy_keys_max=8)), AffinityPipeline(t, small_params())
    assert [r.person_id for r in pipe._facts_by_person.hot.select("person_id").distinct().collect()] == ["P0"]
    for name in ("person_topic_share", "entity_implications", "tier_implications", "person_total_counts"):
        assert rows(build(pipe, name)) == rows(build(plain, name)), name
    pipe.unpersist()
    plain.unpersist()


# --- one JSON array over many tasks -----------------------------------------------------
@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", [64, 1 << 20])
def test_a_topic_array_is_read_in_splits(spark, tmp_path, indent, split):
    rng = random.Random(7)
    odd = ['a "quoted] [name', "back\\slash]", 'ends with \\"', "]],[[", "", "ü]", "plain", "\\\\]", None]
    made = [[str(k), [rng.choice(odd), rng.choice(odd)]] for k in range(60)]
    path = tmp_path / "topic.json"
    path.write_text(json.dumps(made, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        items = topic_json.json_array_items(spark, str(path))
        df = topic_json.read_topic_array(spark, str(path))
        got = sorted(map(tuple, df.collect()), key=repr)
        if split == 64:
            assert spark.read.option("lineSep", "]").text(str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(((k, a, b) for k, (a, b) in made), key=repr) and items.columns == ["value"]


def test_empty_and_short_topic_arrays(spark, tmp_path):
    for text, want in (("[]", []), ("", []), ('[["1", []]]', [("1", None, None)]), ('[["1"], ["2", ["a"]]]', [("1", None, None), ("2", "a", None)])):
        path = tmp_path / "t.json"
        path.write_text(text)
        assert rows(topic_json.read_topic_array(spark, str(path))) == want
