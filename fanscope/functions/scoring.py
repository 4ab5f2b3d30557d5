"""Scoring expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanscope.params import AffinityParams

# --- Fixed values: avidity tiers and entity avidity scores ---
TIER_AVID = "Avid"
TIER_INTERMEDIATE = "Intermediate"
TIER_CASUAL = "Casual"
TIER_NON_FAN = "Non-Fan"
SCORE_BASIC = 1      # among the most-liked topic entities (basic_frac)
SCORE_COMMON = 2     # among the commonly liked topic entities (common_frac)
SCORE_TOPIC = 4      # any other topic entity
SCORE_OTHER = 0      # not a topic entity
# --- End of fixed values ---

# Floating sums depend on summation order; ranks and ties are decided on the
# score rounded to this many decimals.
RANK_DECIMALS = 9


def implication_score(share_sum: Column, n_likers: Column, exponent: float) -> Column:
    """sum(share) / n^exponent: mean topic share of an entity's likers, weighted
    up by popularity^(1-exponent)."""
    return share_sum / F.pow(n_likers.cast("double"), F.lit(exponent))


def rank_key(score: Column) -> Column:
    return F.round(score, RANK_DECIMALS)


def percent(numerator: Column, denominator: Column) -> Column:
    """100 * n / d as double; NULL when d is 0 or NULL."""
    return F.try_divide(F.lit(100.0) * numerator.cast("double"), denominator.cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def avidity_tier(score: Column, p: AffinityParams) -> Column:
    return (F.when(score >= p.tier_avid, TIER_AVID)
            .when(score >= p.tier_intermediate, TIER_INTERMEDIATE)
            .when(score >= p.tier_casual, TIER_CASUAL)
            .otherwise(TIER_NON_FAN))


def entity_avidity_score(is_basic: Column, is_common: Column, is_topic: Column) -> Column:
    """Exclusive: basic 1, else common 2, else topic 4, else 0."""
    return (F.when(is_basic, SCORE_BASIC)
            .when(is_common, SCORE_COMMON)
            .when(is_topic, SCORE_TOPIC)
            .otherwise(SCORE_OTHER))
