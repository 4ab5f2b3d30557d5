"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE sizes shuffle partitions from measured map
# output, turns sort-merge joins into broadcast joins only when the measured
# build side is small, and splits hot partitions of skewed joins (a single
# person or entity may hold a large share of all facts). Forcing the skew split
# keeps it on even when it costs an extra shuffle downstream.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "fanscope", extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with fanscope's defaults.

    On a cluster use `spark-submit` with the cluster's own configuration; this
    helper is for tests, benchmarks and local runs.
    """
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder the cluster names in
    `spark.checkpoint.dir`. Only a local-mode session without one (tests,
    local runs) gets a fresh temporary folder; on a cluster a machine-local
    folder would not be visible to the executors, so none is invented.
    Lineage is cut by writing tables there (`fanscope.sinks.materialize`),
    not by RDD checkpoints, so the SparkContext is left as configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            return None
        path = tempfile.mkdtemp(prefix="fanscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpoint_root(spark: SparkSession) -> str:
    path = ensure_checkpoint_dir(spark)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder on storage that all executors share: kept "
                         "tables are written there (only store='none' keeps nothing)")
    return os.path.join(path, "fanscope")
