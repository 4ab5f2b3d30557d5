"""Adapter from the driver-generated TPC-H-style parquet tables to the logical
affinity tables (mapping in FIXTURES.md section 2).

customers are people, parts are liked entities, order lines are like facts,
nations are locations and regions are countries. Profile attributes are derived
from the customer key by fixed rules so that every cleaning path is exercised.
"""

from __future__ import annotations

import dataclasses
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanscope import vocab
from fanscope.params import AffinityParams
from fanscope.sinks import write_topic_file
from fanscope.sinks.runs import RunFolder
from fanscope.sources.schemas import (DIM_LIKE_TSV, DIM_LOCATION_TSV, FACT_LIKE_TSV, FACT_LOCATION_TSV, PERSON_INFO_TSV,
                                      AffinityTables, TsvLayout)
from fanscope.sources.tables import load_tsv_tables
from fanscope.sources.topic_json import entity_json, topic_from_json_texts

# --- Fixed values of the fixture mapping ---
FIXTURE_CATEGORIES = {
    "people": ["PROMO", "ECONOMY"],
    "music": ["PROMO", "SMALL"],
    "new_media": ["MEDIUM", "ECONOMY"],
    "old_media": ["LARGE", "STANDARD", "PROMO"],
}
FIXTURE_NAMES = ["red plate", "blue ring", "old gear", "Hot Rod"]
# --- End of fixed values ---

RAW_TABLES = {"fact_like": FACT_LIKE_TSV, "dim_like": DIM_LIKE_TSV, "fact_location": FACT_LOCATION_TSV,
              "dim_location": DIM_LOCATION_TSV, "person_info": PERSON_INFO_TSV}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _first_match(k: Column, cases: list[tuple[Column, Column]], default: Column) -> Column:
    expr = None
    for cond, value in cases:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def fixture_person_info(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    birthday = _first_match(k, [
        (k % 10 == 0, null),
        (k % 17 == 0, F.lit("circa 1980")),
        (k % 19 == 0, F.lit("13/45/1990")),
    ], F.date_format(F.date_add(F.lit("1905-01-01").cast("date"),
                                ((k * 7919) % 38000).cast("int")), "MM/dd/yyyy"))
    relationship = _first_match(k, [
        (k % 6 == 0, null),
        (k % 11 == 0, F.lit("04/05/2010")),
        (k % 5 == 1, F.lit("engaged (Pending)")),
        (k % 5 == 2, F.lit("in an OPEN relationship")),
    ], F.lit("single"))
    gender = _first_match(k, [(k % 8 == 0, null), (k % 2 == 0, F.lit("female"))], F.lit("male"))
    locale = _first_match(k, [(k % 9 == 0, null), (k % 3 == 0, F.lit("hi_IN"))], F.lit("en_US"))
    return customer.select(k.alias("person_id"), birthday.alias("birthday_raw"),
                           relationship.alias("relationship_raw"),
                           gender.alias("gender_raw"), locale.alias("locale_raw"))


def fixture_census(spark: SparkSession) -> DataFrame:
    age = F.col("id").cast("int")
    return spark.range(0, 101).select(
        age.alias("age"),
        F.when(age < 7, F.lit(0)).otherwise(F.lit(1000) * (age + 1)).cast("bigint").alias("population"))


#: Variants of the mapping, for cases that the plain one doesn't have.
#: curated: the topic is not the discovered set. Entities whose name begins with token A join it,
#:   every third one stands there twice (under another name), and two ids are no entities.
#: multirow: every fourth entity has a second (name, type) row.
#: vocabulary: types are the default category types in turn, every fifth name a default name.
#: raw: the tables are written as the original job's tab-separated files and its topic file (with
#:   ragged lines and `null` marks), and read back from there.
#: spread, bucketed: the plain tables, under parameters by which no set is small, or frames by person
#:   are kept in buckets (see plans.queries).
VARIANTS = ("plain", "curated", "multirow", "vocabulary", "raw", "spread", "bucketed")


def default_types() -> list[str]:
    """The default category types in order of first mention."""
    return list(dict.fromkeys(t for types in vocab.CATEGORY_GROUPS.values() for t in types))


def _curated(topic: DataFrame, dim_like: DataFrame, token_a: str) -> DataFrame:
    added = dim_like.filter(F.lower("name").startswith(token_a))
    again = topic.filter(F.col("like_id") % 3 == 1).withColumn("name", F.concat("name", F.lit(" again")))
    absent = topic.sparkSession.range(1, 3).select((-F.col("id")).alias("like_id"), F.lit("nobody").alias("name"),
                                                   F.lit("none").alias("type"))
    return topic.unionByName(added).unionByName(again).unionByName(absent)


def _raw_lines(df: DataFrame, layout: TsvLayout) -> DataFrame:
    """The rows of `df` as lines of a raw table: fields that the analysis doesn't read hold a dash,
    missing ones the word null."""
    at = {pos: F.coalesce(F.col(name).cast("string"), F.lit("null")) for name, pos in layout.positions.items() if name in df.columns}
    return df.select(F.concat_ws("\t", *[at.get(k, F.lit("-")) for k in range(max(max(at), layout.min_fields_exclusive) + 1)]).alias("value"))


def _through_raw_files(t: AffinityTables) -> AffinityTables:
    """The same tables, written as raw files in a run's folder and read back by the raw readers, with
    ids as they were. Ragged lines among them are to be skipped."""
    spark = t.fact_like.sparkSession
    folder = RunFolder(spark, "raw")
    for name, layout in RAW_TABLES.items():
        lines = _raw_lines(getattr(t, name), layout)
        ragged = spark.createDataFrame([("",), ("x",), ("x\ty" + "\t" * 40,)], "value string")
        lines.unionByName(ragged).write.mode("overwrite").text(folder.table(name))
    write_topic_file(t.topic, folder.table("topic"))
    back = load_tsv_tables(spark, folder.path, folder.table("topic"), "lines", t.categories, t.names)

    def typed(name: str) -> DataFrame:
        df, was = getattr(back, name), getattr(t, name)
        return df.select(*[df[c].cast(was.schema[c].dataType).alias(c) for c in was.columns])

    # The files' names differ from run to run; what they were made of doesn't.
    return dataclasses.replace(t, folders=[folder], **{name: typed(name) for name in (*RAW_TABLES, "topic")})


def _turn(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def load_fixture_tables(spark: SparkSession, sf_dir: str, params: AffinityParams,
                        variant: str = "plain") -> AffinityTables:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    lineitem = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    fact_like = (lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
                 .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
                         F.col("o_custkey").alias("person_id"),
                         F.col("l_partkey").alias("like_id")))
    dim_like = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("like_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("type"))
    customer = _read(spark, sf_dir, "customer")
    fact_location = customer.select(F.col("c_custkey").alias("person_id"),
                                    F.col("c_nationkey").alias("location_id"))
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    dim_location = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("location_id"), F.col("r_name").alias("country"),
        F.when(F.col("n_nationkey") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("n_name")).alias("state"))

    # The topic file is the discovered entities written as entity JSON and
    # read back, so the JSON source is exercised end to end.
    from fanscope.operators.topic import discover_entities
    discovered = discover_entities(dim_like, params.token_a, params.token_b)
    if variant == "curated":
        discovered = _curated(discovered, dim_like, params.token_a)
    texts = discovered.select(entity_json(F.col("like_id"), F.col("name"), F.col("type")).alias("value"))
    topic = topic_from_json_texts(texts, "value", "bigint")

    categories, names = FIXTURE_CATEGORIES, FIXTURE_NAMES
    if variant == "multirow":
        second = dim_like.filter(F.col("like_id") % 4 == 0).select(
            "like_id", F.concat("name", F.lit(" II")).alias("name"), F.lit("SECOND").alias("type"))
        dim_like = dim_like.unionByName(second)
    elif variant == "vocabulary":
        categories, names = dict(vocab.CATEGORY_GROUPS), list(vocab.SLICE_NAMES)
        k = F.col("like_id")
        dim_like = dim_like.select(
            "like_id", F.when(k % 5 == 0, _turn(names, k)).otherwise(F.col("name")).alias("name"),
            _turn(default_types(), k).alias("type"))

    roots = [os.path.join(sf_dir, f"{t}.parquet")
             for t in ("lineitem", "orders", "part", "customer", "nation", "region")]
    tables = AffinityTables(fact_like=fact_like, dim_like=dim_like,
                            fact_location=fact_location, dim_location=dim_location,
                            person_info=fixture_person_info(customer), topic=topic,
                            census=fixture_census(spark), categories=categories, names=names, roots=roots)
    return _through_raw_files(tables) if variant == "raw" else tables
