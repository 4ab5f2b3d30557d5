"""Factor report: population, fans, fan likes, edge people and fandom per level
of any person attribute, with the derived ratios, in a single aggregation.

The original job computes each metric with its own join and collects a map per
metric to the driver; here one row per person carries all flags, the factor is
joined once, and one groupBy produces every metric.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fanscope.functions.scoring import percent, ratio

METRIC_COLUMNS = ("population", "fans", "fan_likes", "edge", "fandom_sum",
                  "mean_fan_likes", "fan_concentration", "edge_concentration", "fandom")


def person_metrics(summary: DataFrame, edge: DataFrame | None) -> DataFrame:
    """(person_id, n_topic, share, is_edge), one row per person with a region
    like (`summary` from `affinity.person_summary`): n_topic is NULL for
    non-fans, share NULL for people without a topic-or-big like, is_edge NULL
    unless an edge non-fan. Edge people are a subset of the summary, so one
    left join keeps everyone. With `edge=None` is_edge is all NULL and the
    edge computation (which needs the whole implication ranking) is skipped."""
    people = summary.select(
        "person_id",
        F.when(F.col("n_topic") > 0, F.col("n_topic")).alias("n_topic"),
        F.when(F.col("n_relevant") > 0,
               F.col("n_topic").cast("double") / F.col("n_relevant")).alias("share"))
    if edge is None:
        return people.withColumn("is_edge", F.lit(None).cast("boolean"))
    return people.join(edge.select("person_id", F.lit(True).alias("is_edge")), "person_id", "left")


def factor_report(metrics: DataFrame, factor: DataFrame, level_col: str) -> DataFrame:
    """One row per factor level with a population.

    population          people with at least one region like
    fans                people with at least one topic like
    fan_likes           distinct topic entities liked, summed over fans
    edge                edge non-fans
    fandom_sum          topic share summed over people with a share
    mean_fan_likes      fan_likes / fans
    fan_concentration   100 * fans / population
    edge_concentration  100 * edge / population
    fandom              100 * fandom_sum / fans
    A person with several levels counts at each of them.
    """
    return _report(metrics, factor.select("person_id", level_col), level_col)


def _report(metrics: DataFrame, factor: DataFrame, *by: str) -> DataFrame:
    agg = (metrics.join(factor, "person_id")
           .groupBy(*by)
           .agg(F.count(F.lit(1)).alias("population"),
                F.count("n_topic").alias("fans"),
                F.coalesce(F.sum("n_topic"), F.lit(0)).cast("bigint").alias("fan_likes"),
                F.count("is_edge").alias("edge"),
                F.count("share").alias("n_with_share"),
                F.coalesce(F.sum("share"), F.lit(0.0)).alias("fandom_sum")))
    return agg.select(
        *by, "population", "fans", "fan_likes", "edge", "fandom_sum",
        ratio(F.col("fan_likes"), F.col("fans")).alias("mean_fan_likes"),
        percent(F.col("fans"), F.col("population")).alias("fan_concentration"),
        percent(F.col("edge"), F.col("population")).alias("edge_concentration"),
        percent(F.col("fandom_sum"), F.col("fans")).alias("fandom"),
        "n_with_share")


def long_factors(factors: dict[str, DataFrame]) -> DataFrame:
    """(person_id, attribute, level): the (person_id, <attribute>) frames under each other, levels as text."""
    parts = [df.select("person_id", F.lit(name).alias("attribute"), F.col(name).cast("string").alias("level"))
             for name, df in factors.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def factor_reports(metrics: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """The reports of several attributes in one join and one aggregation: attribute, level (as text)
    and the columns of `factor_report`."""
    return _report(metrics, long_factors(factors), "attribute", "level")


def one_report(reports: DataFrame, attribute: str, level_type: DataType) -> DataFrame:
    """One attribute's report out of `factor_reports`, its levels in their own type."""
    return (reports.filter(F.col("attribute") == attribute)
            .withColumn("level", F.col("level").cast(level_type)).withColumnRenamed("level", attribute).drop("attribute"))


# Each single-metric view keeps the levels the original per-metric map had:
# a level appears only where the metric's underlying people exist.
# name -> (metric columns, columns that must all be > 0 for the level to show)
SINGLE_METRICS = {
    "person_counts_by_factor": (("population",), ("population",)),
    "fan_counts_by_factor": (("fans",), ("fans",)),
    "edge_counts_by_factor": (("edge",), ("edge",)),
    "fan_like_counts_by_factor": (("fan_likes",), ("fans",)),
    "mean_fan_likes_by_factor": (("mean_fan_likes",), ("fans",)),
    "fan_concentration_by_factor": (("fan_concentration",), ("fans",)),
    "edge_concentration_by_factor": (("edge_concentration",), ("edge",)),
    "fandom_by_factor": (("fandom_sum", "fandom"), ("fans", "n_with_share")),
}


def needs_edge(name: str) -> bool:
    """Whether a single-metric view reads the edge count."""
    cols, present = SINGLE_METRICS[name]
    return any(c.startswith("edge") for c in (*cols, *present))


def single_metric(report: DataFrame, level_col: str, name: str) -> DataFrame:
    cols, present = SINGLE_METRICS[name]
    keep = functools.reduce(lambda a, b: a & b, [F.col(c) > 0 for c in present])
    return report.filter(keep).select(level_col, *cols)


def report_columns(report: DataFrame, level_col: str) -> DataFrame:
    return report.select(level_col, *METRIC_COLUMNS)
