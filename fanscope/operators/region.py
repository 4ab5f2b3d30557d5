"""Region restriction: people with a location in one country, and their likes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.operators.joins import spread_join


def country_locations(dim_location: DataFrame, country: str) -> DataFrame:
    """(location_id, country) for locations in `country`."""
    return (dim_location.filter(F.col("country") == F.lit(country))
            .select("location_id", "country").distinct())


def state_locations(dim_location: DataFrame, country: str) -> DataFrame:
    """(location_id, state) for locations in `country` that name a state."""
    return (dim_location.filter((F.col("country") == F.lit(country)) & F.col("state").isNotNull())
            .select("location_id", "state").distinct())


def _located(fact_location: DataFrame, locations: DataFrame, slices: int | None) -> DataFrame:
    if slices is None:
        return fact_location.join(locations, "location_id")
    return spread_join(fact_location, locations, "location_id", "person_id", slices)


def region_people(fact_location: DataFrame, locations: DataFrame, slices: int | None = None) -> DataFrame:
    """(person_id, country): people with at least one of `locations` (from
    `country_locations`).

    The caller sizes the locations. Those that fit come in broadcast; others are
    joined by a shuffle in which each location's people are spread over
    `slices`, since a capital can hold a large share of all people.
    """
    return _located(fact_location, locations, slices).select("person_id", "country").distinct()


def region_people_states(fact_location: DataFrame, locations: DataFrame, slices: int | None = None) -> DataFrame:
    """(person_id, state) for people at one of `locations` (from
    `state_locations`), joined as in `region_people`."""
    return _located(fact_location, locations, slices).select("person_id", "state").distinct()


def like_facts(fact_like: DataFrame) -> DataFrame:
    """Distinct (fact_id, person_id, like_id). A repeat like of one entity by
    one person under another fact_id stays a separate fact."""
    return fact_like.select("fact_id", "person_id", "like_id").distinct()


def region_like_facts(fact_like: DataFrame, people: DataFrame, slices: int | None = None) -> DataFrame:
    """Distinct like facts of region people.

    The semi-join runs before the distinct so only the region's facts are
    deduplicated. With `people` broadcast (the caller counts them), the facts
    are not shuffled by person and the distinct shuffles on all three columns,
    so no single person or entity funnels into one task. With more people,
    `slices` spreads each person's facts by entity over that many partitions of
    the shuffled semi-join.
    """
    facts, people = fact_like.select("fact_id", "person_id", "like_id"), people.select("person_id")
    if slices is None:
        return facts.join(people, "person_id", "left_semi").distinct()
    return spread_join(facts, people, "person_id", "like_id", slices, "left_semi").distinct()
