"""Person attributes of region people: birthday, age, age band, gender,
relationship status and locale. Each attribute is one (person_id, value)
frame, deduplicated, ready to be used as a factor."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanscope.functions.dates import age_band, age_years, parse_birthday
from fanscope.functions.text import clean_relationship, starts_with_digit


def _present(c: Column) -> Column:
    """Not NULL and not empty (the TSV reader already maps '' to NULL; frames
    built another way may not)."""
    return c.isNotNull() & (c != F.lit(""))


def region_profiles(person_info: DataFrame, people: DataFrame) -> DataFrame:
    return person_info.join(people.select("person_id"), "person_id", "left_semi")


def people_birthdays(profiles: DataFrame) -> DataFrame:
    """(person_id, birthday) for fields holding exactly one valid m/d/y date."""
    return (profiles.select("person_id", parse_birthday(F.col("birthday_raw")).alias("birthday"))
            .filter(F.col("birthday").isNotNull())
            .distinct())


def people_ages(birthdays: DataFrame, as_of: dt.date) -> DataFrame:
    return birthdays.select("person_id", age_years(F.col("birthday"), as_of).alias("age")).distinct()


def people_agebands(ages: DataFrame) -> DataFrame:
    return ages.select("person_id", age_band(F.col("age")).alias("ageband")).distinct()


def people_genders(profiles: DataFrame) -> DataFrame:
    return (profiles.filter(_present(F.col("gender_raw")))
            .select("person_id", F.col("gender_raw").alias("gender")).distinct())


def people_relationships(profiles: DataFrame) -> DataFrame:
    """Relationship statuses; values starting with a digit are dates, not
    statuses, and are skipped."""
    raw = F.col("relationship_raw")
    return (profiles.filter(_present(raw) & ~starts_with_digit(raw))
            .select("person_id", clean_relationship(raw).alias("relationship")).distinct())


def people_locales(profiles: DataFrame) -> DataFrame:
    return (profiles.filter(_present(F.col("locale_raw")))
            .select("person_id", F.col("locale_raw").alias("locale")).distinct())
