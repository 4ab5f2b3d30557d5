"""Readers for the original job's raw tab-separated tables.

Lines are read as CSV with a tab between fields, no quoting and a declared
schema of `TsvLayout.width` text fields, so a reader that wants two fields
parses lines into those and the ones that the ragged-row guard needs. Lines
with too few fields are skipped; trailing empty fields don't count (Java's
`String.split` drops them), so a line has more than n fields if any from the
n-th on isn't empty. The string `null` and the empty string become real NULLs
once, here, so no operator needs a missing-value marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanscope.sources import schemas as S


def clean_text(col: Column) -> Column:
    """'null' and '' -> NULL."""
    return F.when((col == F.lit("null")) | (col == F.lit("")), F.lit(None)).otherwise(col)


def read_tsv(spark: SparkSession, path: str, layout: S.TsvLayout) -> DataFrame:
    """Named columns of a raw TSV table. Rows are returned as they are; the
    operators deduplicate after filtering, where it is cheapest."""
    schema = ", ".join(f"c{k} string" for k in range(layout.width))
    df = (spark.read.schema(schema)
          .options(sep="\t", quote="", escape="", maxCharsPerColumn="-1", mode="PERMISSIVE")
          .csv(path))
    behind = [F.col(f"c{k}") for k in range(layout.min_fields_exclusive, layout.width)]
    return (df.filter(F.coalesce(*behind).isNotNull())
            .select(*[clean_text(F.col(f"c{pos}")).alias(name) for name, pos in layout.positions.items()]))


def read_fact_like(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, S.FACT_LIKE_TSV)


def read_dim_like(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, S.DIM_LIKE_TSV).select(*S.DIM_LIKE_COLS)


def read_fact_location(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, S.FACT_LOCATION_TSV)


def read_dim_location(spark: SparkSession, path: str) -> DataFrame:
    # The guard for the state field (> 7 fields) is applied by the region
    # operator through state IS NOT NULL, since a missing field reads as NULL.
    return read_tsv(spark, path, S.DIM_LOCATION_TSV)


def read_person_info(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, S.PERSON_INFO_TSV)
