"""Avidity: score entities by how central they are to the topic, grade people
into tiers by their summed scores, and rank predictors per tier."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.functions.scoring import (TIER_AVID, TIER_CASUAL, TIER_INTERMEDIATE, TIER_NON_FAN,
                                        avidity_tier, entity_avidity_score)
from fanscope.operators.affinity import entity_implications, like_topic_stats, top_implications
from fanscope.operators.joins import Spread, hot_split_join, member_join
from fanscope.operators.selection import among_top, kth_largest
from fanscope.params import AffinityParams


def topic_popularity(big_topic: DataFrame, entity_rows: DataFrame, absent_facts: DataFrame | None,
                     share: DataFrame) -> DataFrame:
    """(like_id, n_likers) for topic entities that are big (only those have
    liker counts): facts of likers who have a share.

    Whoever likes an entity of the entity table has a topic-or-big like and so
    a share, thus all facts of such an entity count (`big_topic`: like_id,
    n_facts). An entity of the topic file that the entity table lacks
    (`absent_facts`: the facts of those, None without such) counts only likers
    with a share by other likes.
    So popularity needs no fact-sized join, and tiers don't wait for the ranking."""
    known = (big_topic.join(entity_rows, "like_id", "left_semi")
             .select("like_id", F.col("n_facts").alias("n_likers")))
    if absent_facts is None:
        return known
    absent = (absent_facts.join(share.select("person_id"), "person_id", "left_semi")
              .groupBy("like_id").agg(F.count(F.lit(1)).alias("n_likers")))
    return known.unionByName(absent)


def top_fraction_count(n_topic: int, frac: float) -> int:
    """floor(n_topic * frac) in double arithmetic."""
    return int(math.floor(n_topic * frac))


def most_liked(popularity: DataFrame, k: int, direct: int) -> DataFrame:
    """(like_id) of the k topic entities with most likers (ties: lower id).

    Up to `direct` this is a per-partition top-k that one task merges. A larger
    k is found as a threshold (see `selection.kth_largest`): the frame is then
    a plain filter of `popularity`, which the caller keeps."""
    if k <= direct:
        return (popularity.orderBy(F.col("n_likers").desc(), F.col("like_id").asc())
                .limit(k).select("like_id"))
    return popularity.filter(among_top(kth_largest(popularity, "n_likers", "like_id", k, direct), "n_likers", "like_id")).select("like_id")


def entity_avidity(topic_and_big: DataFrame, topic_id_df: DataFrame,
                   basic_ids: DataFrame, common_ids: DataFrame) -> DataFrame:
    """(like_id, name, type, avidity) for every topic-or-big entity:
    basic 1, else common 2, else other topic 4, else 0.

    The caller has sized all three id sets, and broadcasts those that fit."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("like_id", F.lit(True).alias(name))

    flagged = (topic_and_big
               .join(flag(topic_id_df, "is_topic"), "like_id", "left")
               .join(flag(basic_ids, "is_basic"), "like_id", "left")
               .join(flag(common_ids, "is_common"), "like_id", "left"))
    score = entity_avidity_score(F.coalesce(F.col("is_basic"), F.lit(False)),
                                 F.coalesce(F.col("is_common"), F.lit(False)),
                                 F.coalesce(F.col("is_topic"), F.lit(False)))
    return flagged.select("like_id", "name", "type", score.alias("avidity"))


def avidity_weights(avidity: DataFrame) -> DataFrame:
    """(like_id, weight): entity scores summed per like_id (an entity with
    several (name, type) rows counts once per row), so the fact join is
    one-to-one."""
    return avidity.groupBy("like_id").agg(F.sum("avidity").alias("weight"))


def person_avidity(region_facts: DataFrame, weights: DataFrame, p: AffinityParams,
                   spread: Spread | None = None) -> DataFrame:
    """(person_id, avidity_score, tier) for people with a topic-or-big like.
    `weights` is `avidity_weights(...)`; the caller decides whether it is
    broadcast, or else how facts are spread."""
    scored = (member_join(region_facts.select("person_id", "like_id"), weights, "like_id", "person_id", spread)
              .groupBy("person_id").agg(F.sum("weight").cast("bigint").alias("avidity_score")))
    return scored.select("person_id", "avidity_score",
                         avidity_tier(F.col("avidity_score"), p).alias("tier"))


def tier_like_stats(big_facts: DataFrame, tiers: DataFrame, share: DataFrame,
                    hot_people: DataFrame | None = None) -> DataFrame:
    """(tier, like_id, share_sum, n_likers) of every tier, non-fans included:
    big-entity facts meet their people's share and tier in one join, and one
    aggregation sums them. Everyone with a share has a tier (both come from
    topic-or-big likes), so the sums over the tiers are the whole ranking's."""
    graded = share.join(tiers.select("person_id", "tier"), "person_id")
    return like_topic_stats(hot_split_join(big_facts, graded, "person_id", hot_people), "tier")


def over_all_tiers(stats: DataFrame) -> DataFrame:
    """(like_id, share_sum, n_likers): `tier_like_stats` summed over the tiers."""
    return stats.groupBy("like_id").agg(F.sum("share_sum").alias("share_sum"), F.sum("n_likers").alias("n_likers"))


def tier_implications(stats: DataFrame, topic_and_big: DataFrame, exponent: float) -> DataFrame:
    """(tier, like_id, name, type, score, n_likers) for Avid, Intermediate and
    Casual people, from `tier_like_stats`."""
    return entity_implications(stats.filter(F.col("tier") != F.lit(TIER_NON_FAN)), topic_and_big, exponent, "tier")


def top_per_tier(tier_impl: DataFrame, k: int) -> DataFrame:
    """The k best predictors of each fan tier. There are three fixed tiers, so
    this is three bounded top-k selections (per-partition top-k, one merge),
    not a window over each tier's full ranking. It reads `tier_impl` three
    times; the pipeline keeps it."""
    parts = [top_implications(tier_impl.filter(F.col("tier") == F.lit(t)), k)
             for t in (TIER_AVID, TIER_INTERMEDIATE, TIER_CASUAL)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
