"""Query registry: every result of the analysis under a stable name.

Each builder takes an `AffinityPipeline` and returns a DataFrame. Outputs are
normalized for comparison and reporting: doubles are rounded to
`RANK_DECIMALS` (floating sums depend on summation order; the rounded value is
the one ranks and ties are decided on).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from fanscope.functions.scoring import RANK_DECIMALS
from fanscope.operators import factors
from fanscope.params import AffinityParams
from fanscope.plans.pipeline import FACTOR_ATTRIBUTES, AffinityPipeline
from fanscope.sources.schemas import AffinityTables

# The factor the single-metric reports are shown for (any person attribute
# works; see AffinityPipeline.factor_report).
DEFAULT_FACTOR = "gender"


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), RANK_DECIMALS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _implication_cols(df: DataFrame) -> DataFrame:
    return df.select("like_id", "name", "type", "score", "n_likers")


def _gender_report(p: AffinityPipeline, with_edge: bool = True) -> DataFrame:
    return p.factor_report(p.people_genders, DEFAULT_FACTOR, with_edge)


def _factor(attr: str) -> Callable[[AffinityPipeline], DataFrame]:
    return lambda p: factors.report_columns(p.factor_report_of(attr), attr)


def _single(name: str) -> Callable[[AffinityPipeline], DataFrame]:
    return lambda p: factors.single_metric(_gender_report(p, factors.needs_edge(name)),
                                           DEFAULT_FACTOR, name)


BUILDERS: dict[str, Callable[[AffinityPipeline], DataFrame]] = {
    # sources and region
    "like_facts": lambda p: p.like_facts,
    "entities": lambda p: p.entities,
    "discover_entities": lambda p: p.discovered_entities,
    "topic_entities": lambda p: p.topic_entities,
    "region_people": lambda p: p.region_people,
    "region_people_states": lambda p: p.region_people_states,
    "region_like_facts": lambda p: p.region_facts,
    "person_total_counts": lambda p: p.person_total_counts,
    "big_likes": lambda p: p.big_likes,
    "topic_and_big_likes": lambda p: p.topic_and_big_likes,
    # share
    "person_relevant_counts": lambda p: p.person_relevant_counts,
    "topic_like_facts": lambda p: p.topic_like_facts,
    "person_topic_counts": lambda p: p.person_topic_counts,
    "person_topic_share": lambda p: p.person_topic_share,
    # implications
    "big_like_facts": lambda p: p.big_like_facts,
    "like_topic_fractions": lambda p: p.like_topic_fractions,
    "like_topic_sum": lambda p: p.like_topic_stats.select("like_id", "share_sum"),
    "like_topic_count": lambda p: p.like_topic_stats.select("like_id", "n_likers"),
    "entity_implications": lambda p: _implication_cols(p.entity_implications),
    "top_implications": lambda p: _implication_cols(p.top_implications()),
    "reported_top_implications": lambda p: _implication_cols(p.ranked_report()),
    "offtopic_implications": lambda p: _implication_cols(p.offtopic_implications),
    "top_offtopic": lambda p: _implication_cols(p.top_offtopic()),
    # edge
    "edge_likers": lambda p: p.edge_likers,
    "edge_nonfans": lambda p: p.edge_nonfans,
    # profiles
    "region_profiles": lambda p: p.region_profiles,
    "people_birthdays": lambda p: p.people_birthdays,
    "people_ages": lambda p: p.people_ages,
    "people_agebands": lambda p: p.people_agebands,
    "people_genders": lambda p: p.people_genders,
    "people_relationships": lambda p: p.people_relationships,
    "people_locales": lambda p: p.people_locales,
    # factor reports (by gender)
    **{name: _single(name) for name in factors.SINGLE_METRICS},
    "factor_report": lambda p: factors.report_columns(_gender_report(p), DEFAULT_FACTOR),
    **{f"factor_report_{attr}": _factor(attr) for attr in FACTOR_ATTRIBUTES if attr != DEFAULT_FACTOR},
    # slices
    "implications_category_people": lambda p: _implication_cols(p.category_slice("people")),
    "implications_category_music": lambda p: _implication_cols(p.category_slice("music")),
    "implications_category_new_media": lambda p: _implication_cols(p.category_slice("new_media")),
    "implications_category_old_media": lambda p: _implication_cols(p.category_slice("old_media")),
    "implications_names": lambda p: _implication_cols(p.name_slice()),
    # avidity
    "topic_popularity": lambda p: p.topic_popularity,
    "entity_avidity": lambda p: p.entity_avidity,
    "person_avidity": lambda p: p.person_avidity,
    "tier_implications": lambda p: p.tier_implications,
    "top_tier_implications": lambda p: p.top_tier_implications(),
    # census
    "estimated_fans_by_age": lambda p: p.estimated_fans_by_age,
}


# Results that are also shown on a variant of the inputs (see sources.fixtures).
VARIANT_RESULTS = {
    "curated": ("topic_entities", "topic_and_big_likes", "person_topic_counts", "person_topic_share",
                "entity_implications", "offtopic_implications", "entity_avidity", "person_avidity",
                "tier_implications"),
    "multirow": ("entities", "topic_and_big_likes", "person_relevant_counts", "person_topic_share",
                 "entity_implications", "entity_avidity", "person_avidity", "tier_implications"),
    "vocabulary": ("implications_category_people", "implications_category_music",
                   "implications_category_new_media", "implications_category_old_media", "implications_names"),
    "raw": ("like_facts", "entities", "region_people", "region_people_states", "region_profiles", "topic_entities",
            "person_topic_share", "entity_implications", "reported_top_implications", "person_avidity",
            "estimated_fans_by_age"),
    "spread": ("region_people", "region_people_states", "region_like_facts", "topic_like_facts", "big_like_facts",
               "person_relevant_counts", "person_topic_share", "like_topic_fractions", "entity_implications",
               "edge_likers", "topic_popularity", "entity_avidity", "person_avidity", "tier_implications"),
    "bucketed": ("region_like_facts", "person_total_counts", "person_relevant_counts", "person_topic_counts",
                 "person_topic_share", "like_topic_fractions", "entity_implications", "person_avidity",
                 "tier_implications", "edge_nonfans"),
}


def variant_pipeline(tables: AffinityTables, params: AffinityParams, variant: str) -> AffinityPipeline:
    """The analysis as a variant runs it. "spread": nothing is broadcast by the pipeline, so joins of
    facts take their shuffled, spread forms, heavy entities and hot people are split out at small
    shares, and the most liked entities are found by threshold. "bucketed": facts and frames by
    person are tables bucketed by person, the heaviest people beside them. "raw": frames are kept in (and
    reused from) fingerprinted checkpoints."""
    if variant == "spread":
        params = dataclasses.replace(params, broadcast_max_bytes=0, direct_top_max=0, heavy_keys_max=1500,
                                     hot_person_share=0.05)
    elif variant == "bucketed":
        params = dataclasses.replace(params, person_buckets=6, heavy_keys_max=200)
    return AffinityPipeline(tables, params, store="checkpoint" if variant == "raw" else "memory")


def registry() -> dict[str, tuple[str, str]]:
    """name -> (input variant, result): every registered query."""
    out = {name: ("plain", name) for name in BUILDERS}
    out.update({f"{variant}_{name}": (variant, name) for variant, names in VARIANT_RESULTS.items() for name in names})
    return out


def build(pipeline: AffinityPipeline, name: str) -> DataFrame:
    return normalize(BUILDERS[name](pipeline))
