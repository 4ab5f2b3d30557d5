"""Writers: topic entity files, ranked reports, tables written unless they are
current, and fingerprinted checkpoints in the shared checkpoint folder (their
folders: `fanscope.sinks.runs`)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanscope.functions.scoring import rank_key
from fanscope.sinks.runs import read_text, write_text
from fanscope.sources.topic_json import entity_json


def write_topic_file(entities: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One entity JSON text `["id",["name","type"]]` per line; readable back
    with `fanscope.sources.topic_json.read_topic_lines`."""
    (entities.select(entity_json(F.col("like_id"), F.col("name"), F.col("type")).alias("value"))
     .write.mode(mode).text(path))


def write_ranked_report(implications: DataFrame, path: str, k: int, mode: str = "overwrite") -> None:
    """Top k rows by score as JSON lines, best first. The top-k is taken per
    partition and merged once (no global sort); the result is one ordered
    file of at most k rows."""
    (implications.orderBy(rank_key(F.col("score")).desc(), F.col("like_id").asc()).limit(k)
     .coalesce(1).write.mode(mode).json(path))


def write_unless_current(df: DataFrame, path: str, fingerprint: str) -> bool:
    """Write parquet unless the table at `path` was written under the same
    fingerprint (of everything that the rows depend on). The mark is written
    after the table and goes with it, so a failed write is not current.
    Returns whether it wrote."""
    mark = os.path.join(path, "_fingerprint")
    if read_text(df.sparkSession, mark) == fingerprint:
        return False
    df.write.mode("overwrite").parquet(path)
    write_text(df.sparkSession, mark, fingerprint)
    return True


def input_fingerprint(files: list[str], extra: str = "") -> str:
    h = hashlib.sha256(extra.encode())
    for f in sorted(files):
        h.update(f.encode())
        h.update(b"\0")
    return h.hexdigest()[:16]


def _complete(spark: SparkSession, path: str) -> bool:
    # Spark writes a _SUCCESS marker when a write job commits; a folder
    # without it is a failed attempt and is recomputed.
    return read_text(spark, os.path.join(path, "_SUCCESS")) is not None


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Compute-or-reuse: read the parquet at `path` if a completed write is
    there, else write `df` there and read it back. The returned frame has no
    lineage beyond the files, so lost executors never recompute upstream
    stages. `path` must be on storage every executor sees (use a folder under
    the cluster's `spark.checkpoint.dir`) and must encode everything the
    result depends on (see `input_fingerprint`)."""
    spark = df.sparkSession
    if not _complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
