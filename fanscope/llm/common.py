"""Helpers that the operators share: scratch tables, batches, ordered slices."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanscope.sinks.runs import RunFolder, run_folder

#: Bytes of text that one vectorised step handles at once, and rows at most. Rows are never cut:
#: a longer text is a step of its own.
STEP_BYTES, STEP_ROWS = 2 << 20, 1024


#: The folders of the open scratch() blocks, and by application that of all work outside of them.
_blocks: list[RunFolder] = []
_folders: dict[str, RunFolder] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators keep within the block are deleted at its end, so results that read them
    are to be written or collected before."""
    with run_folder(spark, "llm") as folder:
        _blocks.append(folder)
        try:
            yield
        finally:
            _blocks.remove(folder)


def release() -> None:
    """Delete the tables that operators kept outside of scratch() blocks; also done at the driver's exit."""
    for folder in _folders.values():
        with contextlib.suppress(Exception):  # the session may have ended; the folder's lease will
            folder.release()
    _folders.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that spark.checkpoint.dir names, which all executors share."""
    application = spark.sparkContext.applicationId
    if not _blocks and application not in _folders:
        if not _folders:
            atexit.register(release)
        _folders[application] = RunFolder(spark, "llm")
    return (_blocks[-1] if _blocks else _folders[application]).table(f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written to shared storage: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, made longer until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = STEP_BYTES,
          max_rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `max_bytes` of the string column `text`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), at + max_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]
