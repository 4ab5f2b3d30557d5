"""Topic entity lists as JSON.

One entity is the JSON text `["<like_id>", ["<name>", "<type>"]]`. A topic file
is either one such text per line (what `fanscope.sinks.write_topic_file`
writes) or a single JSON array of them (the original job's format).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def entity_json(like_id: Column, name: Column, type_: Column) -> Column:
    """Format one entity as `["id",["name","type"]]`."""
    quoted_id = F.regexp_replace(F.to_json(F.array(like_id.cast("string"))), r"^\[|\]$", "")
    return F.concat(F.lit("["), quoted_id, F.lit(","), F.to_json(F.array(name, type_)), F.lit("]"))


def parse_entity_json(text: Column, id_type: DataType | str = "string") -> list[Column]:
    """Columns (like_id, name, type) from one entity JSON text.

    Spark's `from_json` with `array<string>` returns nested arrays as their JSON
    text, so the attribute pair is parsed in a second step.
    """
    outer = F.from_json(text, "array<string>")
    attrs = F.from_json(F.get(outer, 1), "array<string>")
    return [F.get(outer, 0).cast(id_type).alias("like_id"),
            F.get(attrs, 0).alias("name"),
            F.get(attrs, 1).alias("type")]


def topic_from_json_texts(df: DataFrame, col: str = "value",
                          id_type: DataType | str = "string") -> DataFrame:
    """Parse a column of entity JSON texts. Rows come back as they are; the
    pipeline deduplicates the topic (a repeated id counts once)."""
    return (df.select(*parse_entity_json(F.col(col), id_type))
            .filter(F.col("like_id").isNotNull()))


def read_topic_lines(spark: SparkSession, path: str,
                     id_type: DataType | str = "string") -> DataFrame:
    """Topic file with one entity JSON text per line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return topic_from_json_texts(lines, "value", id_type)


def _running(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier pieces of the same file as `name`: within a split by a
    window (a split is as much as one task reads), over splits by their totals."""
    pieces = pieces.withColumn("_value", value)
    totals = pieces.groupBy("file", "split").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "split", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (pieces.join(totals, ["file", "split"])
            .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
            .drop("_value", "_before"))


def json_array_items(spark: SparkSession, path: str) -> DataFrame:
    """(value): the texts of the items, arrays themselves, of files that hold one JSON array each.

    A file is read in splits like any text, cut at each closing bracket. How many quotes stand
    before a piece says whether it begins inside a string; the brackets outside strings give the
    depth; an item ends where the depth falls back to that of the outer array. So a file of any
    size is read by many tasks, and its layout (all on one line, or indented) doesn't matter."""
    pieces = spark.read.option("lineSep", "]").text(path).select(
        "value", F.input_file_name().alias("file"), F.input_file_block_start().alias("split"),
        F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r"\\.", "")  # without escaped characters
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    pieces = _running(pieces, quotes, "quotes")
    starts_inside = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(starts_inside, F.lit('"')).otherwise(F.lit("")), bare), '"[^"]*("|$)', "")
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("["), F.lit("")))
    closed = F.when((F.col("quotes") + quotes) % 2 == 0, 1).otherwise(0)  # else the bracket is text
    pieces = _running(pieces.withColumns({"change": opened - closed, "closed": closed}), F.col("change"), "depth")
    ends = F.when((F.col("closed") == 1) & (F.col("depth") + F.col("change") == 1), 1).otherwise(0)
    pieces = _running(pieces.withColumn("ends", ends), F.col("ends"), "item")
    joined = F.transform(F.sort_array(F.collect_list(F.struct("split", "at", "value"))), lambda p: p["value"])
    items = (pieces.groupBy("file", "item").agg(F.max("ends").alias("whole"), joined.alias("parts"))
             .filter(F.col("whole") == 1))
    # The outer array's bracket or a comma stands before an item.
    return items.select(F.regexp_replace(F.concat(F.array_join("parts", "]"), F.lit("]")),
                                         r"^\s*(\[(?=\s*\[)|,)\s*", "").alias("value"))


def read_topic_array(spark: SparkSession, path: str,
                     id_type: DataType | str = "string") -> DataFrame:
    """Topic file holding one JSON array of entities (the original format)."""
    return topic_from_json_texts(json_array_items(spark, path), "value", id_type)
