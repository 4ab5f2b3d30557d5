"""Selection of the k-th largest row of a large frame without a sort.

The rows are counted in equal ranges of the value (a histogram of at most
`BUCKETS` rows); the range that holds the k-th row is counted again in finer
ranges, until one value is left: at most a few passes over two thin columns,
each a partial aggregation. Of rows with exactly that value, the smallest `tie`
keys come first; the last of them is found likewise, by number or by one more
character of text at a time, until few enough are left for a bounded top-k.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ranges that one pass counts.
BUCKETS = 1024


class Cut(NamedTuple):
    """The k-th row: its value, and the last tie key that is in (None: all are)."""
    value: int
    tie: Any


def _narrowed(df: DataFrame, column: str, k: int, low: int, high: int, largest: bool) -> tuple[int, int]:
    """The k-th largest (or smallest) of a whole-number column between `low` and `high`, and k less the
    rows beyond it (its place among equal ones, from 1)."""
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.expr(f"({column} - ({low}L)) div {width}L")
        counts = {r["b"]: r["n"] for r in df.filter(F.col(column).between(low, high))
                  .groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(counts, reverse=largest):
            if k <= counts[b]:
                break
            k -= counts[b]
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low, k


def _kth_text(df: DataFrame, column: str, k: int, direct: int) -> str:
    """The k-th smallest of a text column, by code points."""
    prefix = ""
    while True:
        if df.limit(direct + 1).count() <= direct:
            return df.orderBy(column).limit(k).agg(F.max(column)).first()[0]
        # Texts that end here have no next character and come first.
        char = F.substring(column, len(prefix) + 1, 1)
        counts = {r["c"]: r["n"] for r in df.groupBy(char.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for c in sorted(counts):
            if k <= counts[c]:
                break
            k -= counts[c]
        if c == "":
            return prefix
        df, prefix = df.filter(char == F.lit(c)), prefix + c


def kth_largest(df: DataFrame, value: str, tie: str, k: int, direct: int) -> Cut | None:
    """The cut after the k rows with largest whole-number `value` (ties: smaller `tie` first); None if
    there are no more than k rows. `direct`: tied rows that one task may order."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
    if n <= k:
        return None
    at, place = _narrowed(df, value, k, low, high, largest=True)
    tied = df.filter(F.col(value) == at).select(tie)
    if tied.count() == place:
        return Cut(at, None)
    if isinstance(df.schema[tie].dataType, StringType):
        return Cut(at, _kth_text(tied, tie, place, max(direct, 1)))
    least, most = tied.agg(F.min(tie), F.max(tie)).first()
    return Cut(at, _narrowed(tied, tie, place, least, most, largest=False)[0])


def among_top(cut: Cut | None, value: str, tie: str) -> Column:
    """Whether a row is within the cut."""
    if cut is None:
        return F.lit(True)
    tied = F.col(value) == cut.value
    if cut.tie is not None:
        tied = tied & (F.col(tie) <= F.lit(cut.tie))
    return (F.col(value) > cut.value) | tied
