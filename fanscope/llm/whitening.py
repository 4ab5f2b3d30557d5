"""Embedding whitening by a bit-sliced scatter matrix.

Entries become integers x = floor(256 * c). Each dimension is shifted by its least value, so that it
is a non-negative number of a few bits, and each bit of each dimension is a plane: one bit for each
row, packed 64 rows to a word. Rows in which bit a of dimension i and bit b of dimension j are both
set are counted by AND and popcount, and those counts weighted by 2^(a+b) add up to the exact
cross-products. Shift and centring are undone in whole numbers, n*M - S*S', so no precision is lost
before the eigenvectors are taken (of n^2 * V, divided once).

Scale: three scans of the distinct vectors (ranges and sums; cross-products; the covariance of the
result) and one of all rows; nothing is sorted. Tasks send partial sums: one row for each dimension,
then one for each pair of dimensions and 16 bits of weight, which Spark adds up. The driver gets
the sums, whose number grows with the square of the dimensions and not with the rows.

Defined cases: a row whose vector is null, empty or holds a null or non-finite entry is left out;
vectors of different lengths are fitted separately, each length by itself; entries beyond long are
the nearest long; an eigenvalue of zero (up to rounding) has null for `whitened` and no part in
`identity_error`; `explained` is null if all eigenvalues are zero; `deviation` is null where it does not
fit into a long (from about 10^6 rows of widely spread vectors on); a null vec_id stays null, rows
that agree in vec_id are rows of their own; equal eigenvalues have any basis of their space; a table
without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanscope.llm.common import written

#: Units in 1.0, components that a report has, and bits of weight that one partial sum spans.
UNITS, COMPONENTS, WEIGHT_BITS = 256, 4, 16
#: Rows that are packed into planes at once (a multiple of 64), and words of planes at most.
ROWS, PLANE_WORDS = 4096, 1 << 21
#: Eigenvalues below this share of the largest are zero.
RANK = 1e-12


def is_usable(vector: Column) -> Column:
    """Neither null nor empty, without null and non-finite entries."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


def integer_vector(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * UNITS) + 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list<long> column whose lists have one length, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bit planes of y (uint64, rows x dimensions): one row of packed words for each bit of each dimension."""
    rows = -len(y) % 64
    y = np.concatenate([y, np.zeros((rows, y.shape[1]), np.uint64)]) if rows else y
    dim = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if len(dim) else np.zeros(0, np.int64)
    out = np.empty((len(dim), len(y) // 64), np.uint64)
    for k, (d, b) in enumerate(zip(dim, bit, strict=True)):
        out[k] = np.packbits((y[:, d] >> np.uint64(b)).astype(np.uint8) & 1).view(np.uint64)
    return out


class Scatter:
    """Adds up sums over rows of y_i * y_j in parts: part g of entry (i, j) holds the counts of plane
    pairs (a, b) with (a + b) // WEIGHT_BITS = g, weighted by 2^((a + b) mod WEIGHT_BITS)."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.dims = bits, len(bits)
        self.used = np.flatnonzero(bits)
        self.start = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        self.bit = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if len(bits) else np.zeros(0, np.int64)
        self.parts = (2 * max([0, *(int(b) - 1 for b in bits)])) // WEIGHT_BITS + 1
        self.sums = np.zeros((self.parts, self.dims, self.dims), np.int64)

    def add(self, y: np.ndarray) -> None:
        packed = planes(y, self.bits)
        for i in self.used:
            later = self.used[self.used >= i]
            heads = self.start[later] - self.start[i]
            for a in range(self.bits[i]):
                own = packed[self.start[i] + a]
                counts = np.bitwise_count(packed[self.start[i]:] & own).sum(1, dtype=np.int64)
                power = self.bit[self.start[i]:] + a
                part, value = power // WEIGHT_BITS, counts << (power % WEIGHT_BITS)
                for g in range(int(part.min()), int(part.max()) + 1):
                    self.sums[g, i, later] += np.add.reduceat(np.where(part == g, value, 0), heads)

    def rows(self) -> pa.RecordBatch:
        g, i, j = np.nonzero(self.sums)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g), pa.array(self.sums[g, i, j])],
                                          names=["i", "j", "part", "total"])


@dataclass
class Ranges:
    """The fit list's rows and, by dimension, sums, least values and bits above them."""
    n: int
    sums: list[int]
    least: np.ndarray
    bits: np.ndarray


@dataclass
class Model:
    """What the fit list gives: its rows n, sums S, eigenvalues (falling), unit eigenvectors (columns), trace."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > RANK * max(self.values[0], 0) if len(self.values) else self.values > 0


def ranges(fit: DataFrame) -> Ranges:
    """Of the distinct vectors `x` (all of one length)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, least, most = 0, 0, 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            dims = len(least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (np.arange(dims), np.full(dims, n), low, high, least, most)],
                names=["i", "n", "low", "high", "least", "most"])

    rows = (fit.select("x").mapInArrow(partial, "i long, n long, low long, high long, least long, most long").groupBy("i")
            .agg(F.sum("n"), F.sum("low"), F.sum("high"), F.min("least"), F.max("most")).orderBy("i").collect())
    return Ranges(rows[0][1], [r[2] + (r[3] << 32) for r in rows], np.array([r[4] for r in rows], np.int64),
                  np.array([(r[5] - r[4]).bit_length() for r in rows], np.int64))


def cross_products(fit: DataFrame, of: Ranges) -> list[list[int]]:
    """The exact sums of x_i * x_j over the fit list."""
    least, bits = of.least, of.bits
    step = max(64, min(ROWS, PLANE_WORDS * 64 // max(1, int(bits.sum())) // 64 * 64))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting, rows = Scatter(bits), [], 0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                waiting.append(x.view(np.uint64) - least.view(np.uint64))  # modulo 2^64, so right for any longs
                rows += len(x)
            if rows >= step:
                y = np.concatenate(waiting)
                for at in range(0, rows - rows % step, step):
                    found.add(y[at:at + step])
                waiting, rows = [y[rows - rows % step:]], rows % step
        if rows:
            found.add(np.concatenate(waiting))
        yield found.rows()

    rows = (fit.select("x").mapInArrow(partial, "i long, j long, part long, total long").groupBy("i", "j", "part")
            .agg(F.sum("total").alias("total")).toArrow())
    dims = len(bits)
    m = [[0] * dims for _ in range(dims)]
    for i, j, part, total in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        m[i][j] += total << (part * WEIGHT_BITS)
    low = [int(v) for v in least]
    shifted = [s - of.n * v for s, v in zip(of.sums, low, strict=True)]
    for i in range(dims):
        for j in range(i, dims):  # sum (y_i + m_i) (y_j + m_j)
            m[i][j] += low[i] * shifted[j] + low[j] * shifted[i] + of.n * low[i] * low[j]
            m[j][i] = m[i][j]
    return m


def fitted(fit: DataFrame) -> Model:
    """The model of the distinct vectors `x`, all of one length."""
    of = ranges(fit)
    n, s = of.n, of.sums
    m = cross_products(fit, of)
    # Python divides whole numbers of any size with one rounding.
    v = np.array([[(n * m[i][j] - s[i] * s[j]) / (n * n) for j in range(len(s))] for i in range(len(s))], float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[lead, np.arange(len(s))])  # the largest entry is positive
    return Model(n, s, values, vectors, sum(n * m[i][i] - s[i] * s[i] for i in range(len(s))) / (n * n))


def whitened(x: np.ndarray, model: Model, components: int) -> np.ndarray:
    """Rows times components; null components are NaN."""
    mean = np.array([s / model.n for s in model.sums])
    k, live = slice(0, components), model.live[:components]
    scale = np.where(live, np.sqrt(np.where(live, model.values[k], 1.0)), np.nan)
    return (x - mean) @ model.vectors[:, k] / scale


def deviations(x: np.ndarray, model: Model) -> np.ma.MaskedArray:
    """Sums of (n*x - S)^2, exact; masked where they do not fit into a long."""
    terms = x.astype(float) * model.n - np.array([float(s) for s in model.sums])
    fits = (terms * terms).sum(1) < 2.0 ** 63 * (1 - 1e-9)
    sums = np.array([s & (1 << 64) - 1 for s in model.sums], np.uint64)
    t = x.view(np.uint64) * np.uint64(model.n) - sums  # modulo 2^64, as is the sum of squares
    return np.ma.MaskedArray((t * t).sum(1, dtype=np.uint64).view(np.int64), ~fits)


def identity_error(fit: DataFrame, model: Model, components: int) -> float | None:
    """The largest absolute entry of the covariance of the fit list's whitened vectors less the identity."""
    live = np.flatnonzero(model.live[:components])
    if not len(live):
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                w = whitened(x, model, components)[:, live]
                total, square = total + w.sum(0), square + w.T @ w
        i, j = np.indices(square.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i]), pa.array(square.ravel())],
                                         names=["i", "j", "total", "square"])

    rows = (fit.select("x").mapInArrow(partial, "i long, j long, total double, square double").groupBy("i", "j")
            .agg(F.sum("total"), F.sum("square")).collect())
    mean = {r[0]: r[2] / model.n for r in rows}
    return max(abs(r[3] / model.n - mean[r[0]] * mean[r[1]] - (r[0] == r[1])) for r in rows)


def projected(rows: DataFrame, model: Model, components: int, error: float | None) -> DataFrame:
    """For each row (vec_id, x) and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    count = min(components, len(model.values))
    # A variance is never below zero; its rounding error may be.
    explained = [max(float(e), 0.0) / model.trace if model.trace else None for e in model.values[:count]]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            w, off = whitened(x, model, count).ravel(), deviations(x, model)
            size = batch.num_rows * count
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(size, model.n)),
                pa.array(np.repeat(off.data, count), mask=np.repeat(np.ma.getmaskarray(off), count)),
                pa.array(w, mask=np.isnan(w)),
                pa.array(explained * batch.num_rows, pa.float64()),
                pa.array([error] * size, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        report, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitening_report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row of `embeddings` (vec_id, embedding) and each of the first `components`:
    vec_id, component, n, deviation, whitened, explained, identity_error."""
    vector = F.col("embedding")
    rows = (embeddings.filter(is_usable(vector))
            .select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(vector).alias("x")))
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    lengths = [r[0] for r in distinct.select(F.size("x")).distinct().orderBy(F.size("x")).collect()]
    reports = []
    for length in lengths:
        fit = distinct.filter(F.size("x") == length)
        model = fitted(fit)
        error = identity_error(fit, model, components)
        reports.append(projected(rows.filter(F.size("x") == length), model, components, error))
    if not reports:
        return projected(rows.limit(0), Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), components, None)
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out
