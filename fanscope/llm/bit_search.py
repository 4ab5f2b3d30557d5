"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes.

A vector o is c + r * u: the mean c of all vectors, the length r of what is left and its direction u.
A fixed random rotation spreads u over B code dimensions (B at least `CODE_FACTOR` times the vector's
dimensions: a longer code is a finer one), and the code keeps the signs, packed into words. With x
the unit vector of the signs, <u, q> is about <x, q'> / <x, u'> for a rotated query q', without bias;
<x, u'> is kept as a correction scalar. The error has a standard deviation of at most
|q| * sqrt((1 - <x,u'>^2) / <x,u'>^2 / (B - 1)), and `SIGMAS` of it give bounds.

The query is rounded to `QUERY_BITS` bits a dimension, so <x, q'> is a weighted sum of popcounts of
AND-ed words, one for each bit plane of the query. Per block, the best estimates are reranked first
with the original vectors; their K-th exact score then is the bar, and every vector whose upper bound
reaches it is reranked too. Results carry exact scores; a true neighbour is missed only if its estimate
is off by more than `SIGMAS` standard deviations.

Scale: vectors that are equal are searched once, with the least of their ids (more can't be among
the nearest), so a vector that holds a third of all rows is one candidate and one query. Distinct
queries and candidates are dealt into blocks by hash, each pair of blocks is one group of a
shuffle and holds at most about `QUERY_BLOCK` times `ROW_BLOCK` pairs, of which only arrays of one query by
`ROW_BLOCK` exist at a time. A pair of blocks returns the K best of each query; these are merged by a
window with a limit pushed below its exchange. Work grows as queries times rows, as the whole table
is searched for each query; no row is left out by a cluster or a cap.

Defined cases: rows whose vec_id is null or whose vector is null, empty, zero or holds a null or
non-finite entry take no part; vectors meet vectors of their own length only; of several vectors
under one vec_id the least one counts, repeated rows count once; ties go to the smaller vec_id, equal
vectors have equal scores; a query without another row has no result; a table without rows gives none;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanscope.llm.common import parallelism, written

#: Neighbours of a query, and which vec_ids are queries.
NEAREST, QUERY_EVERY = 20, 20
#: Code bits a dimension, code bits at least, bits of a query's entries, standard deviations of the bounds.
CODE_FACTOR, LEAST_BITS, QUERY_BITS, SIGMAS = 4, 256, 4, 4.0
#: Distinct queries and vectors of a block at most (by mean), at least, and best estimates that set the bar.
QUERY_BLOCK, ROW_BLOCK, LEAST_QUERIES, LEAST_ROWS, FIRST = 8192, 32768, 256, 4096, 64
#: Query vectors whose members are spread, at most (about 1 MB, broadcast).
HOT = 10_000
SEED = 13


@functools.lru_cache(4)
def rotation(dims: int) -> np.ndarray:
    """Orthonormal columns: a random rotation of vectors padded with zeros to the code's length."""
    bits = max(LEAST_BITS, -(-CODE_FACTOR * dims // 64) * 64)
    return np.linalg.qr(np.random.default_rng([SEED, dims]).normal(size=(bits, dims)))[0]


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, one for each vec_id: id, vector (doubles)."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (embeddings.filter(F.col("vec_id").isNotNull() & finite & F.exists(vector, lambda c: c != 0))
            .select(F.col("vec_id").cast("long").alias("id"), F.transform(vector, lambda c: c.cast("double") + 0.0).alias("vector"))
            .groupBy("id").agg(F.min("vector").alias("vector")))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """The vectors of `rows`, each once, with its `copies` least ids (the window's limit runs before its
    exchange as well): vector, ids."""
    least = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return (rows.withColumn("place", least).filter(F.col("place") <= copies)
            .groupBy("vector").agg(F.collect_list("id").alias("ids")))


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for dims, _, v in by_length(batch.column(0)):
                sums[dims] = sums.get(dims, 0.0) + v.sum(0)
                counts[dims] = counts.get(dims, 0) + len(v)
        for dims, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dims, dims)), pa.array(np.arange(dims)), pa.array(np.full(dims, counts[dims])), pa.array(s)],
                names=["dims", "i", "n", "total"])

    rows = (vectors.select("vector").mapInArrow(partial, "dims long, i long, n long, total double").groupBy("dims", "i")
            .agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("dims", "i").collect())
    out: dict[int, list[float]] = {}
    for r in rows:
        out.setdefault(r.dims, []).append(r.mean)
    return {dims: np.array(v) for dims, v in out.items()}


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the lists in a column: the length, the rows that have it, their matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield int(dims), rows, values[starts[rows, None] + np.arange(dims)]


def encoded(v: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors v: code words (rows x words), the length of v - mean, and <x, u'>."""
    rest = v - mean
    length = np.sqrt((rest * rest).sum(1))
    turned = rest @ turn.T / np.where(length > 0, length, 1.0)[:, None]
    words = np.packbits(turned > 0, axis=1).view(np.uint64)
    return words, length, np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def query_planes(q: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A rotated query as low + step * (whole number of QUERY_BITS bits): packed bit planes, low, step."""
    low, step = float(q.min()), float(np.ptp(q)) / ((1 << QUERY_BITS) - 1)
    whole = np.rint((q - low) / (step or 1.0)).astype(np.uint8)
    return np.stack([np.packbits(whole >> b & 1).view(np.uint64) for b in range(QUERY_BITS)]), low, step


class Block:
    """Candidates of one length: vectors, their ids (rows x copies, padded with the largest long), codes."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, mean: np.ndarray):
        self.v, self.ids = v, ids
        self.turn = rotation(v.shape[1])
        words, length, cosine = encoded(v, mean, self.turn)
        self.words = np.ascontiguousarray(words.T)  # word by word, so that one query runs along the rows
        self.ones = np.bitwise_count(self.words).sum(0, dtype=np.int64).astype(float)
        bits = self.turn.shape[0]
        self.bits, self.mean = bits, mean
        safe = np.where(cosine > 0, cosine, 1.0)
        self.scale = length / safe / math.sqrt(bits)
        #: Standard deviations of the estimate, in units of the query's length: of the code, and of the query's rounding.
        self.spread = length * np.sqrt(np.maximum(1 - cosine * cosine, 0)) / safe / math.sqrt(max(bits - 1, 1))
        self.rounding = length / safe

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with q, and how far they may be off."""
        turned = self.turn @ q
        planes, low, step = query_planes(turned)
        sums = np.zeros(self.words.shape[1], np.int64)
        for b, plane in enumerate(planes):
            ones = np.zeros(self.words.shape[1], np.int64)
            for own, word in zip(self.words, plane, strict=True):
                if word:
                    ones += np.bitwise_count(own & word)
            sums += ones << b
        # <x, q'> * sqrt(B) is the sum of q' over set bits, less that over the others.
        on = low * self.ones + step * sums
        rounded = low * self.bits + step * sum(int(np.bitwise_count(p).sum()) << b for b, p in enumerate(planes))
        estimate = float(self.mean @ q) + (2 * on - rounded) * self.scale
        off = np.sqrt((self.spread ** 2) * float(q @ q) + (self.rounding * step) ** 2 / 12)
        return estimate, SIGMAS * off + 1e-9 * (np.abs(estimate) + 1)

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.v[rows] * q).sum(1)  # the same order of additions for every row, so equal vectors tie

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest in the block: scores and ids."""
        estimate, off = self.bounds(q)
        first = np.argpartition(-estimate, FIRST)[:FIRST] if len(estimate) > FIRST else np.arange(len(estimate))
        score = self.exact(q, first)
        bar = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -math.inf
        more = estimate + off >= bar
        more[first] = False
        more = np.flatnonzero(more)
        rows, score = np.concatenate([first, more]), np.concatenate([score, self.exact(q, more)])
        if len(score) > k:  # at least one id each: below the k-th score no id is needed
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        ids, score = self.ids[rows].ravel(), np.repeat(score, self.ids.shape[1])
        there = ids != np.iinfo(np.int64).max
        ids, score = ids[there], score[there]
        order = np.lexsort((ids, -score))[:k]
        return score[order], ids[order]


def padded(column: pa.Array) -> np.ndarray:
    """Lists of ids as a matrix, filled up with the largest long."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), int(lengths.max(initial=1))), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def searched(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For each query (q, vector) its k best ids among `rows` (vector, ids): q and near, a list of
    (less, id), nearest first; `less` is the score with its sign turned."""
    tasks, mean = parallelism(queries.sparkSession), means(rows)
    n, m = queries.count(), rows.count()
    b = max(1, -(-m // ROW_BLOCK), min(tasks, m // LEAST_ROWS))
    a = max(1, -(-n // QUERY_BLOCK), min(-(-2 * tasks // b), n // LEAST_QUERIES))

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("vector"), F.lit(count)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
                .withColumn("pair", F.col("a") * b + F.col("b")).drop("a", "b")
                .repartition(max(tasks, min(a * b, 4 * tasks)), "pair").groupBy("pair"))

    def best(asked: pa.Table, block: pa.Table) -> pa.Table:
        found_q, found_id, found_score = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        ids, q = block.column("ids").combine_chunks(), asked.column("q")
        held = {dims: (at, v) for dims, at, v in by_length(block.column("vector").combine_chunks())}
        for dims, at, vectors in by_length(asked.column("vector").combine_chunks()):
            if dims not in held:
                continue
            own, v = held[dims]
            of = Block(v, padded(ids.take(pa.array(own))), mean[dims])
            for row, vector in zip(at, vectors, strict=True):
                score, near = of.nearest(vector, k)
                found_q.append(np.full(len(near), row))
                found_id.append(near)
                found_score.append(score)
        at = np.concatenate([np.zeros(0, np.int64), *found_q])
        return pa.table({"q": q.take(pa.array(at)), "less": -np.concatenate(found_score), "id": np.concatenate(found_id)})

    found = (dealt(queries, "a", a, "b", b).cogroup(dealt(rows, "b", b, "a", a))
             .applyInArrow(best, "q string, less double, id long"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("less", "id"))
    return (found.withColumn("place", place).filter(F.col("place") <= k)
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("less", "id"))).alias("near")))


def nearest(embeddings: DataFrame, k: int = NEAREST, query_every: int = QUERY_EVERY) -> DataFrame:
    """The k nearest other rows of each row of `embeddings` (vec_id, embedding) whose vec_id is divisible
    by `query_every`: query_id, rank, vec_id, score."""
    rows = written(usable_rows(embeddings), "bit-search-rows")
    asked = rows.filter(F.col("id") % query_every == 0).withColumn(
        "q", F.sha2(F.array_join(F.transform("vector", lambda c: c.cast("string")), " "), 256))
    queries = written(asked.groupBy("q").agg(F.min("vector").alias("vector"), F.count("*").alias("members")), "bit-search-queries")
    # A query's own id may be among the nearest, so one more is looked for.
    vectors = written(distinct_vectors(rows, k + 1), "bit-search-vectors")
    found = searched(queries.select("q", "vector"), vectors, k + 1)
    # Queries with one vector share what was found. Of vectors with many, at most HOT, members are spread.
    share = max(1000, -(-(queries.agg(F.sum("members")).first()[0] or 0) // HOT))
    hot = queries.filter(F.col("members") > share).select("q", F.ceil(F.col("members") / share).alias("parts"))
    members = (asked.select("q", F.col("id").alias("query_id")).join(F.broadcast(hot), "q", "left")
               .withColumn("part", F.pmod(F.xxhash64("query_id"), F.coalesce("parts", F.lit(1)))).drop("parts"))
    spread = (found.join(F.broadcast(hot), "q", "left")
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts"))
    others = F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, k)
    return (members.join(spread, ["q", "part"]).select("query_id", F.posexplode(others).alias("place", "at"))
            .select("query_id", (F.col("place") + 1).alias("rank"), F.col("at.id").alias("vec_id"), (-F.col("at.less")).alias("score")))


def oracle(k: int = NEAREST, query_every: int = QUERY_EVERY) -> str:
    """DuckDB SQL for `nearest` on tables without unusable or repeated rows beside null ones, by brute force."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c <> 0)) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
      FROM v AS q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % {query_every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
