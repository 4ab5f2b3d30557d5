"""Tables laid out by person: bucketed and sorted, so that aggregations and joins by person read
them without an exchange.

A person who holds a large share of all rows would make one bucket as large as that share. The
heaviest (few, found by a sketch) are therefore kept in a table of their own that isn't bucketed;
every frame by person is the union of what comes of either table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.sinks.runs import RunFolder


class ByPerson(NamedTuple):
    """Rows by person: `cold` is bucketed by person_id, `hot` (None without such) holds the heaviest people."""
    cold: DataFrame
    hot: DataFrame | None

    def whole(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot)

    def then(self, f: Callable[[DataFrame], DataFrame]) -> ByPerson:
        """`f`, whose result for a person depends on this person's rows alone, of each part."""
        return ByPerson(f(self.cold), None if self.hot is None else f(self.hot))

    def join(self, other: ByPerson) -> ByPerson:
        """Inner join by person: bucket by bucket, and the heaviest people's rows map-side with the
        other side's, of which there are as few as heavy people (`other` has one for each)."""
        if self.hot is None or other.hot is None:
            return ByPerson(self.cold.join(other.cold, "person_id"), None)
        return ByPerson(self.cold.join(other.cold, "person_id"), self.hot.join(F.broadcast(other.hot), "person_id"))


def bucketed(df: DataFrame, folder: RunFolder, name: str, buckets: int) -> DataFrame:
    """`df` written to the run's folder in `buckets` by person_id, one sorted file each, and read back.
    The catalog entry that names the buckets goes with the folder."""
    table = f"fanscope_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, "person_id").write.format("parquet").option("path", folder.table(name))
     .bucketBy(buckets, "person_id").sortBy("person_id").saveAsTable(table))
    spark = df.sparkSession
    folder.at_release(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))
    return spark.table(table)


def kept_by_person(parts: ByPerson, folder: RunFolder, name: str, buckets: int) -> ByPerson:
    """Both parts, written and read back."""
    return ByPerson(bucketed(parts.cold, folder, name, buckets),
                    None if parts.hot is None else folder.keep(parts.hot, f"{name}_hot"))


def split_by_weight(facts: DataFrame, heavy: DataFrame | None) -> ByPerson:
    """`facts` without and with the people in `heavy` (few)."""
    if heavy is None:
        return ByPerson(facts, None)
    ids = F.broadcast(heavy)
    return ByPerson(facts.join(ids, "person_id", "left_anti"), facts.join(ids, "person_id", "left_semi"))
