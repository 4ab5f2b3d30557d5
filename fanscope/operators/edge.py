"""Edge likers and edge non-fans: people drawn to the strongest off-topic
predictors, and those of them with no topic like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.operators.affinity import top_implications
from fanscope.operators.joins import Spread, member_join


def top_offtopic_ids(offtopic: DataFrame, k: int) -> DataFrame:
    """(like_id) of the k strongest off-topic predictors (bounded by k)."""
    return top_implications(offtopic, k).select("like_id")


def edge_likers(region_facts: DataFrame, top_ids: DataFrame, spread: Spread | None = None) -> DataFrame:
    """(person_id) of people with a like on a top off-topic predictor.

    The caller has sized `top_ids`; when they are broadcast the facts are never
    shuffled by entity, even when a predictor is a hot key; beyond the bound
    `spread` keeps hot predictors apart.
    """
    return (member_join(region_facts.select("person_id", "like_id"), top_ids, "like_id", "person_id", spread, "left_semi")
            .select("person_id").distinct())


def edge_nonfans(summary: DataFrame, likers: DataFrame) -> DataFrame:
    """(person_id): relevant people who are not fans but are edge likers
    (`summary` from `affinity.person_summary`)."""
    return (summary.filter((F.col("n_relevant") > 0) & (F.col("n_topic") == 0))
            .select("person_id")
            .join(likers, "person_id", "left_semi"))
