from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from fanscope.params import AffinityParams  # noqa: E402
from fanscope.session import SCALE_CONF  # noqa: E402
from fanscope.sources.schemas import AffinityTables  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    builder = (SparkSession.builder.master("local[*]").appName("fanscope-tests")
               .config("spark.sql.shuffle.partitions", "8"))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_tables(spark, facts, entities, people, *, outsiders=(), topic=None,
                profiles=None, census=None, categories=None, names=None) -> AffinityTables:
    """Small in-memory tables: `facts` are (fact_id, person_id, like_id);
    `entities` are (like_id, name, type); `people` live in region "X",
    `outsiders` in region "Y"."""
    fact_like = spark.createDataFrame(facts, "fact_id string, person_id string, like_id string")
    dim_like = spark.createDataFrame(entities, "like_id string, name string, type string")
    locs = [(p, "L1") for p in people] + [(p, "L2") for p in outsiders]
    fact_location = spark.createDataFrame(locs, "person_id string, location_id string")
    dim_location = spark.createDataFrame([("L1", "X", "S1"), ("L2", "Y", "S2")],
                                         "location_id string, country string, state string")
    person_info = spark.createDataFrame(
        profiles if profiles is not None else [(p, None, None, None, None) for p in people],
        "person_id string, birthday_raw string, relationship_raw string, gender_raw string, locale_raw string")
    topic_df = None if topic is None else spark.createDataFrame(
        topic, "like_id string, name string, type string")
    census_df = spark.createDataFrame(census or [(a, 1000) for a in range(101)],
                                      "age int, population bigint")
    return AffinityTables(fact_like=fact_like, dim_like=dim_like, fact_location=fact_location,
                          dim_location=dim_location, person_info=person_info, topic=topic_df,
                          census=census_df, categories=categories or {}, names=names or [])


def small_params(**kw) -> AffinityParams:
    base = dict(region_value="X", token_a="t", token_b="x", big_min_exclusive=1,
                top_offtopic=1, report_top=10, as_of=dt.date(2016, 6, 1))
    base.update(kw)
    return AffinityParams(**base)


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
