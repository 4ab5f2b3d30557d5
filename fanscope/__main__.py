"""Command line: run every report for one topic and region.

  PYTHONPATH=. spark-submit fanscope/__main__.py --data-root hdfs:///data \\
      --topic topic.json --region India --out hdfs:///reports/topic [--store checkpoint]

or, locally, `python -m fanscope ...`. Only the driver imports fanscope: every
operator is a built-in Spark expression, so executors run no Python.

Without --topic the topic is discovered from entity names with
--token-a/--token-b and written to <out>/topic_entities for curation.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import json

from pyspark.sql import SparkSession

from fanscope.params import AffinityParams
from fanscope.plans.pipeline import AffinityPipeline
from fanscope.plans.reports import run_reports
from fanscope.session import SCALE_CONF, checkpoint_root
from fanscope.sources.tables import load_tsv_tables


def parse_args(argv=None) -> argparse.Namespace:
    d = AffinityParams()
    ap = argparse.ArgumentParser(prog="fanscope")
    ap.add_argument("--data-root", required=True)
    ap.add_argument("--topic", default=None, help="topic entity JSON file")
    ap.add_argument("--topic-format", choices=["array", "lines"], default="array")
    ap.add_argument("--out", required=True)
    ap.add_argument("--region", default=d.region_value)
    ap.add_argument("--token-a", default=d.token_a)
    ap.add_argument("--token-b", default=d.token_b)
    ap.add_argument("--big-min-exclusive", type=int, default=d.big_min_exclusive)
    ap.add_argument("--top-offtopic", type=int, default=d.top_offtopic)
    ap.add_argument("--report-top", type=int, default=d.report_top)
    ap.add_argument("--exponent", type=float, default=d.exponent)
    ap.add_argument("--basic-frac", type=float, default=d.basic_frac)
    ap.add_argument("--common-frac", type=float, default=d.common_frac)
    ap.add_argument("--tier-avid", type=int, default=d.tier_avid)
    ap.add_argument("--tier-intermediate", type=int, default=d.tier_intermediate)
    ap.add_argument("--tier-casual", type=int, default=d.tier_casual)
    ap.add_argument("--broadcast-max-rows", type=int, default=d.broadcast_max_rows)
    ap.add_argument("--broadcast-max-bytes", type=int, default=d.broadcast_max_bytes)
    ap.add_argument("--hot-person-share", type=float, default=d.hot_person_share)
    ap.add_argument("--skew-slices", type=int, default=d.skew_slices)
    ap.add_argument("--heavy-keys-max", type=int, default=d.heavy_keys_max)
    ap.add_argument("--person-buckets", type=int, default=d.person_buckets)
    ap.add_argument("--direct-top-max", type=int, default=d.direct_top_max)
    ap.add_argument("--as-of", type=dt.date.fromisoformat, default=d.as_of)
    ap.add_argument("--store", choices=["memory", "checkpoint", "none"], default="memory")
    return ap.parse_args(argv)


def session() -> SparkSession:
    """The session of the job, with the settings that the plans rely on where
    the submitter hasn't set others."""
    builder = SparkSession.builder.appName("fanscope")
    spark = builder.getOrCreate()
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in SCALE_CONF.items():
        if key.startswith("spark.sql.") and key not in given:
            spark.conf.set(key, value)
    return spark


def main(argv=None) -> None:
    a = parse_args(argv)
    given = {f.name: getattr(a, f.name) for f in dataclasses.fields(AffinityParams) if hasattr(a, f.name)}
    params = AffinityParams(region_value=a.region, **given)
    spark = session()
    if a.store != "none":
        checkpoint_root(spark)  # says what is missing before any job runs
    tables = load_tsv_tables(spark, a.data_root, a.topic, a.topic_format)
    pipe = AffinityPipeline(tables, params, store=a.store)
    try:
        written = run_reports(pipe, a.out)
    finally:
        pipe.unpersist()
    print(json.dumps({"written": written}))


if __name__ == "__main__":
    main()
