"""Slices of the implication ranking by entity category or by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_slice(implications: DataFrame, types: list[str]) -> DataFrame:
    """Implications whose entity type is in `types` (a literal vocabulary, so
    the membership test is an IN/INSET predicate, no join)."""
    return implications.filter(F.col("type").isin(list(types)))


def name_slice(implications: DataFrame, names: list[str]) -> DataFrame:
    """Implications whose entity name is in `names`, ignoring case."""
    lowered = sorted({n.lower() for n in names})
    return implications.filter(F.lower(F.col("name")).isin(lowered))
