"""Entities, topic discovery, big entities and the topic-or-big entity set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.functions.text import ordered_token_match


def entities(dim_like: DataFrame) -> DataFrame:
    """Distinct (like_id, name, type)."""
    return dim_like.select("like_id", "name", "type").distinct()


def discover_entities(dim_like: DataFrame, token_a: str, token_b: str) -> DataFrame:
    """Entities whose name matches token A before name+type matches token B.

    The filter is applied before the distinct, so it runs on the scan.
    """
    return (dim_like.select("like_id", "name", "type")
            .filter(ordered_token_match(F.col("name"), F.col("type"), token_a, token_b))
            .distinct())


def topic_ids(topic: DataFrame) -> DataFrame:
    """Distinct topic like_ids (a repeated id in the topic file counts once)."""
    return topic.select("like_id").distinct()


def like_counts(region_facts: DataFrame) -> DataFrame:
    """(like_id, n_facts): liker facts per entity. Partial aggregation collapses
    a hot entity map-side before the shuffle."""
    return region_facts.groupBy("like_id").agg(F.count(F.lit(1)).alias("n_facts"))


def big_likes(region_facts: DataFrame, min_exclusive: int) -> DataFrame:
    """(like_id, n_facts) of entities with more than `min_exclusive` region like facts."""
    return like_counts(region_facts).filter(F.col("n_facts") > F.lit(min_exclusive))


def topic_or_big_ids(topic_id_df: DataFrame, big: DataFrame) -> DataFrame:
    """(like_id) of topic and big entities (an id in both appears twice; the
    semi-join below does not care)."""
    return topic_id_df.select("like_id").unionByName(big.select("like_id"))


def topic_and_big_likes(ids: DataFrame, dim_like: DataFrame) -> DataFrame:
    """(like_id, name, type) for the entities in `ids` found in the entity table.

    Written as a semi-join of the entity table, so the entity table is never
    deduplicated as a whole.
    """
    return (dim_like.select("like_id", "name", "type")
            .join(ids, "like_id", "left_semi")
            .distinct())
