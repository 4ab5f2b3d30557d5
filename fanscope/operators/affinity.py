"""Topic share per person and the entity implication ranking (the flagship).

Counting follows the original job exactly: the relevant-like denominator counts
fact rows (a repeat like counts again, and an entity with several (name, type)
rows counts once per row), while the topic numerator counts distinct
(entity, person) pairs. Only big entities are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.functions.scoring import implication_score, rank_key
from fanscope.operators.joins import Spread, hot_split_join, member_join


def entity_rows(topic_and_big: DataFrame) -> DataFrame:
    """(like_id, n_rows): how many (name, type) rows each topic-or-big entity
    has, so that joining facts to this one-row-per-entity table gives the
    original counts without multiplying fact rows."""
    return topic_and_big.groupBy("like_id").agg(F.count(F.lit(1)).alias("n_rows"))


def person_summary(region_facts: DataFrame, rows_of: DataFrame, topic_facts: DataFrame,
                   spread: Spread | None = None) -> DataFrame:
    """(person_id, n_likes, n_relevant, n_topic), one row per region person
    with a like, in a single aggregation by person:

    n_likes     all region like facts
    n_relevant  facts on topic-or-big entities (per (name, type) row)
    n_topic     distinct topic entities liked

    `rows_of` (from `entity_rows`) is one row per entity; `topic_facts` (from
    `topic_like_facts`) are the distinct pairs of topic entity and person, a
    small part of the facts. Both kinds of rows are summed by hash aggregation,
    partially map-side, so a person with a huge share of all facts collapses
    before the shuffle. `spread` says how facts meet a `rows_of` too large to
    broadcast.
    """
    facts = (member_join(region_facts.select("person_id", "like_id"), rows_of, "like_id", "person_id", spread, "left")
             .select("person_id", F.lit(1).alias("n_likes"),
                     F.coalesce("n_rows", F.lit(0)).alias("n_relevant"), F.lit(0).alias("n_topic")))
    pairs = topic_facts.select("person_id", F.lit(0).alias("n_likes"),
                               F.lit(0).cast("bigint").alias("n_relevant"), F.lit(1).alias("n_topic"))
    return (facts.unionByName(pairs).groupBy("person_id")
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_likes", "n_relevant", "n_topic")]))


def entity_flags(rows_of: DataFrame, topic_id_df: DataFrame) -> DataFrame:
    """(like_id, n_rows, is_topic) of every topic-or-big entity, 0 or 1 for is_topic."""
    return (rows_of.join(topic_id_df.select("like_id", F.lit(1).alias("is_topic")), "like_id", "full")
            .select("like_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("is_topic", F.lit(0)).alias("is_topic")))


def person_summary_by_pairs(facts: DataFrame, flags: DataFrame, spread: Spread | None = None) -> DataFrame:
    """`person_summary` of facts that lie together by person: facts are counted by
    person and entity, which then meet `flags` (from `entity_flags`) once. On
    facts bucketed by person neither aggregation needs an exchange."""
    pairs = facts.groupBy("person_id", "like_id").agg(F.count(F.lit(1)).alias("n"))
    return (member_join(pairs, flags, "like_id", "person_id", spread, "left").groupBy("person_id")
            .agg(F.sum("n").cast("bigint").alias("n_likes"),
                 F.sum(F.col("n") * F.coalesce("n_rows", F.lit(0))).cast("bigint").alias("n_relevant"),
                 F.sum(F.coalesce("is_topic", F.lit(0))).cast("bigint").alias("n_topic")))


def person_total_counts(region_facts: DataFrame) -> DataFrame:
    """(person_id, n_likes): all region likes per person."""
    return region_facts.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_likes"))


def person_relevant_counts(summary: DataFrame) -> DataFrame:
    """(person_id, n_relevant) for people with a topic-or-big like."""
    return summary.filter(F.col("n_relevant") > 0).select("person_id", "n_relevant")


def topic_like_facts(region_facts: DataFrame, topic_id_df: DataFrame, spread: Spread | None = None) -> DataFrame:
    """Distinct (like_id, person_id) pairs on topic entities."""
    return (member_join(region_facts.select("like_id", "person_id"), topic_id_df, "like_id", "person_id",
                        spread, "left_semi")
            .select("like_id", "person_id").distinct())


def person_topic_counts(summary: DataFrame) -> DataFrame:
    """(person_id, n_topic): distinct topic entities liked; the fans."""
    return summary.filter(F.col("n_topic") > 0).select("person_id", "n_topic")


def person_topic_share(summary: DataFrame) -> DataFrame:
    """(person_id, share) = n_topic / n_relevant for people with a
    topic-or-big like (0 for those without topic likes)."""
    return (summary.filter(F.col("n_relevant") > 0)
            .select("person_id", (F.col("n_topic").cast("double") / F.col("n_relevant")).alias("share")))


def big_like_facts(region_facts: DataFrame, big: DataFrame, spread: Spread | None = None) -> DataFrame:
    """(person_id, like_id) facts on big entities; repeat likes are kept. Big
    entities are hot by definition: beyond the broadcast bound `spread` joins
    the heaviest map-side and slices the others."""
    return (member_join(region_facts.select("person_id", "like_id"), big, "like_id", "person_id", spread, "left_semi")
            .select("person_id", "like_id"))


def like_topic_fractions(big_facts: DataFrame, share: DataFrame,
                         hot_people: DataFrame | None = None) -> DataFrame:
    """(like_id, person_id, share): each big-entity fact with its liker's share.

    This is the one fact-sized join keyed by person; people in `hot_people`
    (counted, few) are joined map-side, see `joins.hot_split_join`."""
    return hot_split_join(big_facts, share, "person_id", hot_people).select("like_id", "person_id", "share")


def like_topic_stats(fractions: DataFrame, *group_cols: str) -> DataFrame:
    """(group_cols..., like_id, share_sum, n_likers) in one aggregation."""
    return (fractions.groupBy(*group_cols, "like_id")
            .agg(F.sum("share").alias("share_sum"), F.count(F.lit(1)).alias("n_likers")))


def entity_implications(stats: DataFrame, topic_and_big: DataFrame, exponent: float,
                        *group_cols: str) -> DataFrame:
    """(group_cols..., like_id, name, type, score, n_likers)."""
    return (stats.join(topic_and_big, "like_id")
            .select(*group_cols, "like_id", "name", "type",
                    implication_score(F.col("share_sum"), F.col("n_likers"), exponent).alias("score"),
                    "n_likers"))


def offtopic_implications(implications: DataFrame, topic_id_df: DataFrame) -> DataFrame:
    """Implications of entities outside the topic."""
    return implications.join(topic_id_df, "like_id", "left_anti")


def top_implications(implications: DataFrame, k: int) -> DataFrame:
    """Top k by score (ties: lower like_id first). Planned as
    TakeOrderedAndProject: per-partition top-k, then one k-way merge; no
    global sort."""
    return implications.orderBy(rank_key(F.col("score")).desc(), F.col("like_id").asc()).limit(k)
