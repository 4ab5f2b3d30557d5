"""The hand-worked example of FIXTURES.md section 5, end to end."""

from __future__ import annotations

import pytest

from conftest import make_tables, rows, small_params

from fanscope.plans.pipeline import AffinityPipeline

FACTS = [("f1", "P1", "T1"), ("f2", "P1", "B1"), ("f3", "P2", "B1"), ("f4", "P2", "B2"),
         ("f5", "P3", "B2"), ("f6", "P3", "B1"), ("f7", "P4", "T1"), ("f8", "P5", "B1"),
         ("f9", "P1", "B1")]
ENTITIES = [("T1", "topic one", "Show"), ("B1", "big one", "Band"), ("B2", "big two", "Band")]


@pytest.fixture(scope="module")
def pipe(spark):
    t = make_tables(spark, FACTS, ENTITIES, ["P1", "P2", "P3", "P4"], outsiders=["P5"],
                    topic=[("T1", "topic one", "Show")])
    return AffinityPipeline(t, small_params())


def test_region_facts_drop_outsider(pipe):
    assert pipe.region_facts.count() == 8
    assert rows(pipe.like_facts.filter("person_id = 'P5'"), "fact_id") == [("f8",)]


def test_counts_and_share(pipe):
    assert rows(pipe.big_likes) == [("B1",), ("B2",), ("T1",)]
    assert rows(pipe.person_relevant_counts) == [("P1", 3), ("P2", 2), ("P3", 2), ("P4", 1)]
    assert rows(pipe.person_topic_counts) == [("P1", 1), ("P4", 1)]
    share = dict(rows(pipe.person_topic_share))
    assert share == pytest.approx({"P1": 1 / 3, "P2": 0.0, "P3": 0.0, "P4": 1.0})


def test_scores(pipe):
    got = {r.like_id: (r.score, r.n_likers) for r in pipe.entity_implications.collect()}
    assert got["T1"][0] == pytest.approx(0.820763, abs=1e-6)
    assert got["B1"][0] == pytest.approx(0.252619, abs=1e-6)
    assert got["B2"][0] == 0.0
    assert {k: v[1] for k, v in got.items()} == {"T1": 2, "B1": 4, "B2": 2}


def test_offtopic_and_edge(pipe):
    assert [r.like_id for r in pipe.top_offtopic().collect()] == ["B1", "B2"]
    assert rows(pipe.edge_likers) == [("P1",), ("P2",), ("P3",)]
    assert rows(pipe.edge_nonfans) == [("P2",), ("P3",)]


def test_avidity(pipe):
    assert rows(pipe.entity_avidity, "like_id", "avidity") == [("B1", 0), ("B2", 0), ("T1", 4)]
    assert rows(pipe.person_avidity, "person_id", "tier") == [
        ("P1", "Intermediate"), ("P2", "Non-Fan"), ("P3", "Non-Fan"), ("P4", "Intermediate")]


def test_tier_implications(pipe):
    got = rows(pipe.tier_implications, "tier", "like_id", "n_likers")
    # Intermediate people P1 and P4: P1 likes T1 and B1 twice, P4 likes T1.
    assert got == [("Intermediate", "B1", 2), ("Intermediate", "T1", 2)]


def test_new_offtopic_big_entity_never_raises_a_share(spark, pipe):
    """SURVEY section 5 invariant: a new non-topic big entity adds to the
    denominators only."""
    more = FACTS + [("f10", "P1", "B3"), ("f11", "P2", "B3"), ("f12", "P4", "B3")]
    t = make_tables(spark, more, ENTITIES + [("B3", "big three", "Band")],
                    ["P1", "P2", "P3", "P4"], outsiders=["P5"], topic=[("T1", "topic one", "Show")])
    after = dict(rows(AffinityPipeline(t, small_params()).person_topic_share))
    before = dict(rows(pipe.person_topic_share))
    assert after.keys() == before.keys()
    assert all(after[p] <= before[p] for p in before)
    assert after["P1"] < before["P1"] and after["P4"] < before["P4"]
