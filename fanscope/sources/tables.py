"""Assemble `AffinityTables` from the original job's raw inputs.

data_root/fact_like, dim_like, fact_location, dim_location, person_info are
tab-separated text folders; the topic file is entity JSON (one JSON array, or
one entity per line). Vocabularies and the census default to the original
job's values (`fanscope.vocab`).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from fanscope import vocab
from fanscope.operators.census import census_frame
from fanscope.sources import topic_json, tsv
from fanscope.sources.schemas import AffinityTables


def load_tsv_tables(spark: SparkSession, data_root: str, topic_path: str | None,
                    topic_format: str = "array",
                    categories: dict[str, list[str]] | None = None,
                    names: list[str] | None = None,
                    census_by_age: list[int] | None = None) -> AffinityTables:
    """`topic_path=None` means the topic is discovered from entity names with
    the pipeline's tokens (and can then be written out with
    `fanscope.sinks.write_topic_file` for curation)."""
    def path(name: str) -> str:
        return os.path.join(data_root, name)

    topic = None
    if topic_path is not None:
        reader = topic_json.read_topic_array if topic_format == "array" else topic_json.read_topic_lines
        topic = reader(spark, topic_path)
    return AffinityTables(
        fact_like=tsv.read_fact_like(spark, path("fact_like")),
        dim_like=tsv.read_dim_like(spark, path("dim_like")),
        fact_location=tsv.read_fact_location(spark, path("fact_location")),
        dim_location=tsv.read_dim_location(spark, path("dim_location")),
        person_info=tsv.read_person_info(spark, path("person_info")),
        topic=topic,
        census=census_frame(spark, census_by_age or vocab.CENSUS_LITERATE_POPULATION_BY_AGE),
        categories=categories if categories is not None else dict(vocab.CATEGORY_GROUPS),
        names=names if names is not None else list(vocab.SLICE_NAMES),
        roots=[path(t) for t in ("fact_like", "dim_like", "fact_location", "dim_location", "person_info")]
        + ([topic_path] if topic_path is not None else []),
    )
