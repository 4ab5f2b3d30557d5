"""Golden results of FIXTURES.md section 3 on the driver's sf0.001 fixtures,
plus the section 5 invariants."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA, rows

from fanscope.params import FIXTURE_PARAMS
from fanscope.plans.pipeline import AffinityPipeline
from fanscope.plans.queries import BUILDERS, build
from fanscope.sources.fixtures import load_fixture_tables

SF = os.path.join(TESTDATA, "sf0.001")

GOLDEN_ROWS = {
    "like_facts": 5996, "entities": 200, "region_people": 26, "region_people_states": 23,
    "discover_entities": 7, "topic_entities": 7, "region_like_facts": 1098,
    "person_total_counts": 26, "big_likes": 91, "topic_and_big_likes": 95,
    "person_relevant_counts": 26, "person_topic_share": 26, "topic_like_facts": 31,
    "person_topic_counts": 18, "big_like_facts": 702, "like_topic_fractions": 702,
    "like_topic_sum": 91, "like_topic_count": 91, "entity_implications": 91,
    "offtopic_implications": 88, "top_implications": 50, "top_offtopic": 50, "reported_top_implications": 50,
    "edge_likers": 25, "edge_nonfans": 7, "region_profiles": 26, "people_birthdays": 19,
    "people_ages": 19, "people_agebands": 19, "people_genders": 23, "people_relationships": 19,
    "people_locales": 22, "implications_category_people": 33, "implications_category_music": 34,
    "implications_category_new_media": 29, "implications_category_old_media": 47,
    "implications_names": 10, "topic_popularity": 3, "entity_avidity": 95, "person_avidity": 26,
    "tier_implications": 195, "top_tier_implications": 126, "estimated_fans_by_age": 102, "factor_report": 2,
    "factor_report_age": 16, "factor_report_ageband": 6, "factor_report_relationship": 3,
    "factor_report_locale": 2, "factor_report_state": 4,
    "person_counts_by_factor": 2, "fan_counts_by_factor": 2, "edge_counts_by_factor": 2,
    "fan_like_counts_by_factor": 2, "mean_fan_likes_by_factor": 2,
    "fan_concentration_by_factor": 2, "edge_concentration_by_factor": 2, "fandom_by_factor": 2,
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures not present")


@pytest.fixture(scope="module")
def pipe(spark):
    p = AffinityPipeline(load_fixture_tables(spark, SF, FIXTURE_PARAMS), FIXTURE_PARAMS)
    yield p
    p.unpersist()


def test_every_query_is_registered_with_golden_rows():
    assert set(GOLDEN_ROWS) == set(BUILDERS)


@pytest.mark.parametrize("name", sorted(GOLDEN_ROWS))
def test_row_counts(pipe, name):
    assert build(pipe, name).count() == GOLDEN_ROWS[name]


def test_sums_and_top3(pipe):
    share_sum = pipe.person_topic_share.agg(F.sum("share")).first()[0]
    assert share_sum == pytest.approx(1.229754, abs=1e-6)
    score_sum = pipe.entity_implications.agg(F.sum("score")).first()[0]
    assert score_sum == pytest.approx(7.095616, abs=1e-6)
    top = [(r.like_id, round(r.score, 6), r.n_likers) for r in pipe.top_implications(3).collect()]
    assert top == [(153, 0.199321, 9), (58, 0.153966, 12), (7, 0.150601, 15)]
    off = [(r.like_id, round(r.score, 6), r.n_likers) for r in pipe.top_offtopic(3).collect()]
    assert off == [(58, 0.153966, 12), (7, 0.150601, 15), (165, 0.144888, 10)]


def test_gender_report(pipe):
    rep = {r.gender: r for r in pipe.factor_report(pipe.people_genders, "gender").collect()}
    f, m = rep["female"], rep["male"]
    assert (f.population, f.fans, f.fan_likes, f.edge) == (12, 8, 14, 3)
    assert f.fandom_sum == pytest.approx(0.533886, abs=1e-6)
    assert (m.population, m.fans, m.fan_likes, m.edge) == (11, 8, 14, 3)
    assert m.fandom_sum == pytest.approx(0.576339, abs=1e-6)


def test_attribute_distributions(pipe):
    bands = dict(pipe.people_agebands.groupBy("ageband").count().collect())
    assert bands == {"Under 18": 2, "18-24": 1, "25-34": 3, "35-44": 2, "45-54": 1, "55+": 10}
    rels = dict(pipe.people_relationships.groupBy("relationship").count().collect())
    assert rels == {"Engaged": 2, "In An OPEN Relationship": 5, "Single": 12}


def test_avidity_distributions(pipe):
    av = dict(pipe.entity_avidity.groupBy("avidity").count().collect())
    assert av == {0: 88, 2: 1, 4: 6}
    tiers = dict(pipe.person_avidity.groupBy("tier").count().collect())
    assert tiers == {"Avid": 11, "Intermediate": 6, "Casual": 1, "Non-Fan": 8}
    per_tier = {r.tier: (r.n, r.likers) for r in pipe.tier_implications.groupBy("tier")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("n_likers").alias("likers")).collect()}
    assert per_tier == {"Avid": (90, 288), "Intermediate": (79, 180), "Casual": (26, 32)}


def test_estimated_fans(pipe):
    est = pipe.estimated_fans_by_age
    tot = est.agg(F.sum("estimate"), F.sum("fans"), F.sum("population")).first()
    assert tot[0] == pytest.approx(726000.0)
    assert (tot[1], tot[2]) == (15, 19)
    r100 = est.filter("age = 100").first()
    assert (r100.fans, r100.population, r100.estimate) == (0, 0, 0.0)


# --- invariants ---------------------------------------------

def test_share_bounds_and_disjoint_sets(pipe):
    lo, hi = pipe.person_topic_share.agg(F.min("share"), F.max("share")).first()
    assert 0.0 <= lo and hi <= 1.0
    fans = pipe.person_topic_counts.select("person_id")
    assert pipe.edge_nonfans.join(fans, "person_id").count() == 0
    assert pipe.edge_nonfans.join(pipe.edge_likers, "person_id", "left_anti").count() == 0
    assert pipe.offtopic_implications.join(pipe.topic_ids, "like_id").count() == 0


def test_tier_likers_plus_non_fans_equal_all_likers(pipe):
    non_fans = pipe.person_avidity.filter("tier = 'Non-Fan'").select("person_id")
    rest = (pipe.big_like_facts.join(non_fans, "person_id")
            .groupBy("like_id").agg(F.count(F.lit(1)).alias("n")))
    tiers = pipe.tier_implications.groupBy("like_id").agg(F.sum("n_likers").alias("n"))
    combined = (tiers.unionByName(rest).groupBy("like_id").agg(F.sum("n").alias("n")))
    assert rows(combined) == rows(pipe.like_topic_stats, "like_id", "n_likers")


def test_factor_population_sums_to_people_with_attribute(pipe):
    rep = pipe.factor_report(pipe.people_genders, "gender")
    total = rep.agg(F.sum("population")).first()[0]
    expected = pipe.people_genders.join(pipe.person_total_counts, "person_id").count()
    assert total == expected
