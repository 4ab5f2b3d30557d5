"""Scale sample fan rates by age to population figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanscope.functions.scoring import ratio

MAX_AGE = 100        # ages 0..100 are reported; 100 is "100 and over"


def census_frame(spark: SparkSession, population_by_age: list[int]) -> DataFrame:
    """(age, population) from a list indexed by age."""
    return spark.createDataFrame(list(enumerate(population_by_age)), "age int, population bigint")


def estimated_fans_by_age(by_age_report: DataFrame, census: DataFrame) -> DataFrame:
    """(age, fans, population, estimate) for ages 0..100, and one row without
    an age for people whose age can't be used (born after the reference date).

    `by_age_report` is a factor report over `age`; ages over 100 count as 100,
    the last entry of the census. estimate = fans / population * census
    population, 0 where the sample or the census has nobody. A census with
    several rows for an age counts as their sum. After the aggregations below
    neither side has more than 102 rows, so both are broadcast.
    """
    age = F.col("age")
    usable = F.when(age >= MAX_AGE, F.lit(MAX_AGE)).when(age >= 0, age).cast("int")
    folded = (by_age_report
              .select(usable.alias("age"), "fans", "population")
              .groupBy("age")
              .agg(F.sum("fans").cast("bigint").alias("fans"),
                   F.sum("population").cast("bigint").alias("population")))
    spark = by_age_report.sparkSession
    spine = spark.range(0, MAX_AGE + 2).select(
        F.when(F.col("id") <= MAX_AGE, F.col("id")).cast("int").alias("age"))
    census_pop = (census.filter(age.between(0, MAX_AGE)).groupBy(age.cast("int").alias("census_age"))
                  .agg(F.sum("population").alias("census_population")))
    folded = folded.withColumnRenamed("age", "folded_age")
    joined = (spine.join(F.broadcast(folded), age.eqNullSafe(F.col("folded_age")), "left")
              .join(F.broadcast(census_pop), age == F.col("census_age"), "left"))
    fans = F.coalesce(F.col("fans"), F.lit(0)).cast("bigint")
    pop = F.coalesce(F.col("population"), F.lit(0)).cast("bigint")
    estimate = F.coalesce(ratio(fans, pop) * F.col("census_population"), F.lit(0.0))
    return joined.select("age", fans.alias("fans"), pop.alias("population"),
                         estimate.alias("estimate"))
