"""Edge cases of FIXTURES.md section 4 (semantics decisions D1-D21)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_tables, rows, small_params

from fanscope.functions.dates import age_band, age_years, parse_birthday
from fanscope.functions.scoring import avidity_tier, entity_avidity_score
from fanscope.functions.text import capitalize_words, clean_relationship, ordered_token_match
from fanscope.operators import avidity, census, factors
from fanscope.operators.affinity import top_implications
from fanscope.params import AffinityParams
from fanscope.plans.pipeline import AffinityPipeline


def _one_col(spark, values, typ):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_token_match_null_order_and_type_only(spark):  # D2, D3
    df = spark.createDataFrame(
        [("1", None, "promo"), ("2", "red", None), ("3", "promo red", "x"),
         ("4", "plain", "red promo"), ("5", "red car", "promo"), ("6", "redpromo", "")],
        "id string, name string, type string")
    hit = df.filter(ordered_token_match(F.col("name"), F.col("type"), "red", "promo"))
    assert rows(hit, "id") == [("5",), ("6",)]
    empty = df.filter(ordered_token_match(F.col("name"), F.col("type"), "zzz", "promo"))
    assert empty.count() == 0


def test_birthday_parse_strict(spark):  # D11
    df = _one_col(spark, ["01/02/1990 and 03/04/1991", "13/01/1990", "02/30/1990", "circa 1980",
                          "born 07/04/1976!", None], "string")
    got = [r[0] for r in df.select(parse_birthday(F.col("v"))).collect()]
    assert got == [None, None, None, None, dt.date(1976, 7, 4), None]


def test_age_truncates_365_25_day_years(spark):  # D12
    as_of = dt.date(2016, 6, 1)
    df = spark.createDataFrame([(dt.date(1998, 6, 1),), (dt.date(1998, 6, 2),), (dt.date(2017, 1, 1),)], "b date")
    got = [r[0] for r in df.select(age_years(F.col("b"), as_of)).collect()]
    # 6575 days / 365.25 = 18.001...; one day later is 17.99...; future dates
    # truncate toward zero.
    assert got == [18, 17, 0]


def test_age_band_edges(spark):  # D4
    ages = [17, 18, 24, 25, 34, 35, 44, 45, 54, 55]
    got = [r[0] for r in _one_col(spark, ages, "int").select(age_band(F.col("v"))).collect()]
    assert got == ["Under 18", "18-24", "18-24", "25-34", "25-34", "35-44", "35-44",
                   "45-54", "45-54", "55+"]


def test_tiers(spark):  # D5
    got = [r[0] for r in _one_col(spark, [0, 1, 2, 3, 5, 6], "int")
           .select(avidity_tier(F.col("v"), small_params())).collect()]
    assert got == ["Non-Fan", "Casual", "Casual", "Intermediate", "Intermediate", "Avid"]


def test_entity_both_basic_and_common_scores_one(spark):  # D6
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True),
                                (False, False, False)], "b boolean, c boolean, t boolean")
    got = [r[0] for r in df.select(entity_avidity_score(F.col("b"), F.col("c"), F.col("t"))).collect()]
    assert got == [1, 2, 4, 0]


def test_fandom_sums_doubles_and_mean_divides_doubles(spark):  # D7, D8
    metrics = spark.createDataFrame(
        [("a", 1, 0.5, None), ("b", 2, 0.5, None)],
        "person_id string, n_topic bigint, share double, is_edge boolean")
    factor = spark.createDataFrame([("a", "F"), ("b", "F")], "person_id string, level string")
    r = factors.factor_report(metrics, factor, "level").collect()[0]
    assert r.fandom_sum == 1.0
    assert r.mean_fan_likes == 1.5
    assert r.fandom == pytest.approx(50.0)
    assert r.fan_concentration == 100.0


def test_repeat_like_counts_twice_in_denominator_once_in_numerator(spark):  # D9
    facts = [("f1", "P1", "T1"), ("f2", "P1", "T1"), ("f3", "P1", "B1"), ("f4", "P2", "T1")]
    ents = [("T1", "t", "x"), ("B1", "b", "x")]
    p = AffinityPipeline(make_tables(spark, facts, ents, ["P1", "P2"], topic=[("T1", "t", "x")]),
                         small_params(big_min_exclusive=0))
    assert dict(rows(p.person_relevant_counts)) == {"P1": 3, "P2": 1}
    assert dict(rows(p.person_topic_counts)) == {"P1": 1, "P2": 1}
    assert dict(rows(p.like_topic_stats, "like_id", "n_likers")) == {"T1": 3, "B1": 1}


def test_ages_fold_and_nobody_is_lost(spark):  # D13, D14
    report = spark.createDataFrame(
        [(99, 1, 2), (100, 1, 2), (105, 1, 1), (110, 0, 1), (111, 5, 6), (50, 0, 0), (-1, 2, 3)],
        "age int, fans bigint, population bigint")
    cen = spark.createDataFrame([(a, 500) for a in range(101)] * 2, "age int, population bigint")
    got = {r.age: (r.fans, r.population, r.estimate)
           for r in census.estimated_fans_by_age(report, cen).collect()}
    assert len(got) == 102
    assert got[99] == (1, 2, 500.0)
    assert got[100] == (7, 10, 700.0)
    assert got[7] == (0, 0, 0.0)
    assert got[None] == (2, 3, 0.0)
    assert sum(v[0] for v in got.values()) == 10 and sum(v[1] for v in got.values()) == 15


def test_relationship_cleaning(spark):  # D15
    df = _one_col(spark, ["in an OPEN relationship", "engaged (Pending)", "single", "Engaged (pending)"],
                  "string")
    got = [r[0] for r in df.select(clean_relationship(F.col("v"))).collect()]
    assert got == ["In An OPEN Relationship", "Engaged", "Single", "Engaged (pending)"]


def test_topic_entity_not_big_has_no_implication(spark):  # D16
    facts = [("f1", "P1", "T1"), ("f2", "P1", "B1"), ("f3", "P2", "B1")]
    ents = [("T1", "t", "x"), ("B1", "b", "x")]
    p = AffinityPipeline(make_tables(spark, facts, ents, ["P1", "P2"], topic=[("T1", "t", "x")]),
                         small_params(big_min_exclusive=1))
    assert rows(p.entity_implications, "like_id") == [("B1",)]


def test_ties_keep_lower_id(spark):  # D18
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.5 + 1e-12), ("d", 0.1)],
                               "like_id string, score double")
    assert [r.like_id for r in top_implications(df, 2).collect()] == ["a", "b"]


def test_repeated_topic_ids_are_one(spark):  # D19
    facts = [("f1", "P1", "T1"), ("f2", "P1", "B1"), ("f3", "P2", "B1")]
    ents = [("T1", "t", "x"), ("B1", "b", "x")]
    once = AffinityPipeline(make_tables(spark, facts, ents, ["P1", "P2"], topic=[("T1", "t", "x")]),
                            small_params(big_min_exclusive=0))
    twice = AffinityPipeline(make_tables(spark, facts, ents, ["P1", "P2"],
                                         topic=[("T1", "t", "x"), ("T1", "t", "x")]),
                             small_params(big_min_exclusive=0))
    assert rows(once.entity_implications) == rows(twice.entity_implications)
    assert rows(once.person_topic_share) == rows(twice.person_topic_share)


def test_relationship_empty_or_date_dropped(spark):  # D20
    profiles = [("P1", None, None, None, None), ("P2", None, "04/05/2010", None, None),
                ("P3", None, "single", None, None), ("P4", None, "٣ maybe", None, None),
                ("P5", None, "", "", "")]
    t = make_tables(spark, [("f1", "P1", "B1")], [("B1", "b", "x")], ["P1", "P2", "P3", "P4", "P5"],
                    topic=[("B1", "b", "x")], profiles=profiles)
    p = AffinityPipeline(t, small_params())
    assert rows(p.people_relationships) == [("P3", "Single")]
    assert p.people_genders.count() == 0 and p.people_locales.count() == 0


def test_profile_attributes_are_distinct(spark):  # D21
    profiles = [("P1", "01/02/1990", None, "male", "en_US"), ("P1", "01/02/1990", None, "male", "en_US")]
    t = make_tables(spark, [("f1", "P1", "B1")], [("B1", "b", "x")], ["P1"],
                    topic=[("B1", "b", "x")], profiles=profiles)
    p = AffinityPipeline(t, small_params())
    assert p.people_ages.count() == 1
    assert p.people_genders.count() == 1
    assert p.people_locales.count() == 1


def test_small_topics_get_avidity_too(spark):  # C12
    facts = [(f"f{i}", f"P{i % 4}", e) for i, e in enumerate(["T1", "T2", "T3", "B1"] * 4)]
    ents = [(e, e.lower(), "x") for e in ("T1", "T2", "T3", "B1")]
    t = make_tables(spark, facts, ents, ["P0", "P1", "P2", "P3"], topic=ents[:3])
    p = AffinityPipeline(t, AffinityParams(region_value="X", big_min_exclusive=1))
    assert {r.like_id: r.avidity for r in p.entity_avidity.collect()} == {"T1": 4, "T2": 4, "T3": 4, "B1": 0}
    assert p.person_avidity.count() == 4
    assert p.tier_implications.count() > 0 and p.top_tier_implications().count() > 0


def test_most_liked_by_threshold_is_the_ordered_top(spark):  # W5
    popularity = spark.createDataFrame([(f"E{i:02d}", i // 3) for i in range(20)], "like_id string, n_likers bigint")
    for k in (0, 1, 2, 3, 7, 19, 20, 25):
        want = rows(avidity.most_liked(popularity, k, direct=100))
        assert rows(avidity.most_liked(popularity, k, direct=0)) == want and len(want) == min(k, 20)


def test_words_are_separated_by_any_white_space(spark):
    df = _one_col(spark, ["in a\topen  one", "", " x", "ça va", None], "string")
    got = [r[0] for r in df.select(capitalize_words(F.col("v"))).collect()]
    assert got == ["In A\tOpen  One", "", " X", "Ça Va", None]


def test_single_metrics_that_read_edge_counts_get_them():
    assert {n for n in factors.SINGLE_METRICS if factors.needs_edge(n)} == {
        "edge_counts_by_factor", "edge_concentration_by_factor"}
