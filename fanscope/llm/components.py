"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) of long ids to (id, root): root is the smallest id of id's component. Ids
    without an edge to another have no row. Each round is written to shared storage, and rounds go
    on until nothing changes; a hub's edges are only ever reduced by map-side combining or joined
    with a single row, so it needs no task that holds them all."""
    a, b = F.col("a"), F.col("b")
    edges = written(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).filter(a != b).distinct())
        edges = written(small, "edges")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(b.alias("id")).distinct().withColumn("root", F.col("id"))
            return edges.select(a.alias("id"), b.alias("root")).unionByName(roots)
