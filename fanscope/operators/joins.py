"""Join helpers.

A side is broadcast only if its size is counted and within a bound of rows and
bytes. Beyond it the join shuffles, and keys that may be hot are spread over
slices by another column, so that no key funnels into one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast `df` when the caller has found that its counted size `fits`;
    otherwise return it unchanged so the planner shuffles instead."""
    return F.broadcast(df) if fits else df


def sliced(df: DataFrame, slices: int) -> DataFrame:
    """Every row once for each slice (column `_slice`)."""
    return df.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def spread_join(big: DataFrame, keyed: DataFrame, key: str, by: str, slices: int,
                how: str = "inner") -> DataFrame:
    """Join a fact-sized frame with a thin frame of distinct keys, where a key
    may hold any share of `big`'s rows: `big` is split into slices by a hash of
    `by`, and `keyed` is repeated for each slice.

    The merge hint keeps it a shuffle: Spark estimates the repeated rows by the
    size of the files they come from, so it would broadcast what is `slices`
    times larger (and far larger still in memory) through the driver."""
    spread: Column = F.pmod(F.xxhash64(by), F.lit(slices)).cast("int")
    return (big.withColumn("_slice", spread).join(sliced(keyed, slices).hint("merge"), [key, "_slice"], how)
            .drop("_slice"))


class Spread(NamedTuple):
    """How a shuffle of facts by a key keeps hot keys apart: facts of `hot` keys (one column; None if
    there are none) are joined map-side, the others are spread over `slices`."""
    hot: DataFrame | None
    slices: int


#: Items that the frequent-items sketch tracks for each key it may report, and the groups of tasks
#: whose sketches are merged before the last merge.
TRACKED, MERGE_GROUPS = 16, 64


def heavy_keys(facts: DataFrame, key: str, most: int) -> DataFrame | None:
    """(key): the keys that hold more than 1/most of `facts` (so fewer than `most`); None if none do.

    Each task sketches the frequent items of its rows; the sketches, whose size doesn't depend on
    the rows, are merged in two levels. Counts are underestimated by at most 1/12 of the bound, so
    a key just above it may be left out, which costs balance and no rows."""
    tracked = min(1_000_000, TRACKED * most)
    found = (facts.filter(F.col(key).isNotNull()).select(key)
             .groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("group"))
             .agg(F.expr(f"approx_top_k_accumulate({key}, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n"))
             .groupBy(F.lit(0).alias("all"))  # a group, as there is none without facts
             .agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {most})").alias("top"))
             .first())
    if found is None:
        return None
    heavy = [(r["item"],) for r in found["top"] if r["count"] > found["n"] / most]
    return facts.sparkSession.createDataFrame(heavy, facts.select(key).schema) if heavy else None


def member_join(facts: DataFrame, keyed: DataFrame, key: str, by: str, spread: Spread | None = None,
                how: str = "inner") -> DataFrame:
    """Join facts with a thin frame of distinct keys. Without `spread`, `keyed` comes in broadcast
    (or may be of any size where no key is hot). With it, facts of heavy keys join map-side with
    a broadcast of those keys' rows, and each other key's facts are spread over slices by `by`."""
    if spread is None:
        return facts.join(keyed, key, how)
    if spread.hot is None:
        return spread_join(facts, keyed, key, by, spread.slices, how)
    ids = F.broadcast(spread.hot)
    hot = facts.join(ids, key, "left_semi").join(F.broadcast(keyed.join(ids, key, "left_semi")), key, how)
    cold = spread_join(facts.join(ids, key, "left_anti"), keyed, key, by, spread.slices, how)
    return hot.unionByName(cold)


def hot_split_join(big: DataFrame, keyed: DataFrame, key: str, hot_keys: DataFrame | None) -> DataFrame:
    """Inner join of a fact-sized frame with a frame keyed by `key`, where a
    few keys may be hot (hold a large share of `big`'s rows).

    Rows of hot keys join map-side against a broadcast of the matching rows of
    `keyed` (at most one per hot key; the caller's threshold bounds their
    number); all other rows take the ordinary shuffle join. A hot key therefore
    never lands in a single reduce task. `hot_keys` is a one-column frame of
    keys, or None when nothing is hot.
    """
    if hot_keys is None:
        return big.join(keyed, key)
    hot_ids = F.broadcast(hot_keys.select(key))
    hot_rows = F.broadcast(keyed.join(hot_ids, key, "left_semi"))
    hot = big.join(hot_rows, key)
    cold = big.join(hot_ids, key, "left_anti").join(keyed, key)
    return hot.unionByName(cold)
