"""Property test: the Spark pipeline against a brute-force, plain-Python
rendition of the same semantics on small random like graphs."""

from __future__ import annotations

import math
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import make_tables, small_params

from fanscope.plans.pipeline import AffinityPipeline

PEOPLE = [f"P{i}" for i in range(6)]
LIKES = [f"L{i}" for i in range(8)]


@st.composite
def graphs(draw):
    pairs = draw(st.lists(st.tuples(st.sampled_from(PEOPLE), st.sampled_from(LIKES)),
                          min_size=1, max_size=40))
    dup = draw(st.lists(st.integers(0, len(pairs) - 1), max_size=5))
    facts = [(f"f{i}", p, l) for i, (p, l) in enumerate(pairs)]
    facts += [facts[i] for i in dup]                       # exact duplicate lines
    entities = []
    for like in LIKES:
        n_rows = draw(st.integers(0, 2))                   # 0: missing from the entity table
        entities += [(like, f"name{like}{k}", draw(st.sampled_from(["A", "B"]))) for k in range(n_rows)]
    region = draw(st.sets(st.sampled_from(PEOPLE), min_size=1))
    topic = draw(st.sets(st.sampled_from(LIKES), min_size=1, max_size=4))
    big_min = draw(st.integers(0, 3))
    return facts, entities, sorted(region), sorted(topic), big_min


def brute(facts, entities, region, topic, big_min, p):
    rfacts = sorted({f for f in facts if f[1] in region})
    counts = defaultdict(int)
    for _, _, like in rfacts:
        counts[like] += 1
    big = {l for l, c in counts.items() if c > big_min}
    rows = sorted({e for e in entities if e[0] in big | set(topic)})
    mult = defaultdict(int)
    for like, _, _ in rows:
        mult[like] += 1
    n_rel, topic_likes = defaultdict(int), defaultdict(set)
    for _, person, like in rfacts:
        n_rel[person] += mult.get(like, 0)
        if like in topic:
            topic_likes[person].add(like)
    share = {pp: len(topic_likes[pp]) / n for pp, n in n_rel.items() if n > 0}
    stats = defaultdict(lambda: [0.0, 0])
    for _, person, like in rfacts:
        if like in big and person in share:
            stats[like][0] += share[person]
            stats[like][1] += 1
    impl = sorted((like, name, typ, round(s / math.pow(n, p.exponent), 9), n)
                  for like, name, typ in rows if like in stats for s, n in [stats[like]])
    off = sorted({r for r in impl if r[0] not in topic}, key=lambda r: (-r[3], r[0]))
    top_ids = {r[0] for r in off[:p.top_offtopic]}
    likers = {person for _, person, like in rfacts if like in top_ids}
    nonfans = sorted(pp for pp, n in n_rel.items()
                     if n > 0 and not topic_likes[pp] and pp in likers)
    # avidity
    n_topic = len(set(topic))
    pop = sorted(((stats[l][1], l) for l in set(topic) if l in stats), key=lambda t: (-t[0], t[1]))
    basic = {l for _, l in pop[:int(math.floor(n_topic * p.basic_frac))]}
    common = {l for _, l in pop[:int(math.floor(n_topic * p.common_frac))]}
    weight = defaultdict(int)
    for like, _, _ in rows:
        weight[like] += 1 if like in basic else 2 if like in common else 4 if like in topic else 0
    score = defaultdict(int)
    for _, person, like in rfacts:
        if like in mult:                       # only entities found in the entity table
            score[person] += weight[like]
    def tier(s):
        return "Avid" if s >= 6 else "Intermediate" if s >= 3 else "Casual" if s >= 1 else "Non-Fan"
    tiers = sorted((pp, s, tier(s)) for pp, s in score.items())
    tstats = defaultdict(lambda: [0.0, 0])
    tier_of = {pp: t for pp, _, t in tiers}
    for _, person, like in rfacts:
        if like in big and person in share and tier_of.get(person, "Non-Fan") != "Non-Fan":
            tstats[(tier_of[person], like)][0] += share[person]
            tstats[(tier_of[person], like)][1] += 1
    timpl = sorted((t, like, name, typ, round(s / math.pow(n, p.exponent), 9), n)
                   for (t, like), (s, n) in tstats.items()
                   for l2, name, typ in rows if l2 == like)
    return share, impl, nonfans, tiers, timpl


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(graphs())
def test_pipeline_matches_brute_force(spark, g):
    facts, entities, region, topic, big_min = g
    params = small_params(big_min_exclusive=big_min, top_offtopic=2)
    topic_rows = [(t, "t", "x") for t in topic]
    pipe = AffinityPipeline(make_tables(spark, facts, entities, region, topic=topic_rows,
                                        outsiders=[p for p in PEOPLE if p not in region]), params)
    share, impl, nonfans, tiers, timpl = brute(facts, entities, region, topic, big_min, params)
    try:
        got_share = {r.person_id: r.share for r in pipe.person_topic_share.collect()}
        assert got_share.keys() == share.keys()
        assert all(math.isclose(got_share[k], v, abs_tol=1e-12) for k, v in share.items())
        got_impl = sorted((r.like_id, r.name, r.type, round(r.score, 9), r.n_likers)
                          for r in pipe.entity_implications.collect())
        assert got_impl == impl
        assert sorted(r.person_id for r in pipe.edge_nonfans.collect()) == nonfans
        got_tiers = sorted((r.person_id, r.avidity_score, r.tier) for r in pipe.person_avidity.collect())
        assert got_tiers == tiers
        got_timpl = sorted((r.tier, r.like_id, r.name, r.type, round(r.score, 9), r.n_likers)
                           for r in pipe.tier_implications.collect())
        assert got_timpl == timpl
    finally:
        pipe.unpersist()
