"""Quality classifier: weak-label model and hashed linear scorer.

Overlapping heuristic labellers (`LABELLERS`) each vote good, bad or nothing on a text.
Expectation-maximisation estimates how often each votes which way on good texts and on texts of
each fault, from the counts of vote patterns over all documents. The posterior of a pattern labels its documents,
and a linear model on hashed features learns those labels. A document is rejected if its score,
the chance that it is good, is below `KEEP`.

Features are hashed byte trigrams of the text (square roots of their shares) and the labellers'
measures in steps. The model is fitted on a bounded sample, about `SAMPLE` documents chosen by a
hash of doc_id and text; the vote counts cover all.

Scale: two passes over the texts (votes, scores) without a shuffle of documents. The driver gets one
count for each vote pattern (at most 3 ** 8) and the sample's features (about 32 MB).

Defined cases: a null text counts as empty; texts without words get the vote bad and the score that
the model gives; repeated rows are scored alike; a table without rows gives none; other columns are
ignored, and kept by `without_rejected`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm import textvec
from fanscope.llm.common import fresh, steps, text_or_empty, utf8

#: Name; bad below and from; good from and below. Shares are of a text's words, letters or characters.
#: The first five look for one fault each, and vote good where they don't find it.
LABELLERS = (
    ("words that end in a sign", None, 0.25, 0.0, 0.25),
    ("signs among characters", None, 0.18, 0.0, 0.18),
    ("capitals among letters", None, 0.40, 0.0, 0.40),
    ("words that repeat one of the last eight places", None, 0.30, 0.0, 0.30),
    ("words without a letter", None, 0.60, 0.0, 0.60),
    ("words that end a sentence", 0.005, 0.80, 0.02, 0.30),
    ("letters to a word", 2.5, 7.5, 3.5, 6.5),
    ("words", 1, None, 1, np.inf),
)
#: The chance of a fault with which the model starts where a labeller votes bad: one of the first
#: five, and one of the others.
START = (0.9, 0.5)
#: Words from which all but the last vote.
VOTE_WORDS = 5
SAMPLE, BITS, KEEP = 4000, 12, 0.5
ROUNDS = 60
_STEPS = 16

_kind = np.zeros(256, np.uint8)  # 1 sign, 2 small letter, 3 capital
for _c in range(33, 127):
    _kind[_c] = 3 if chr(_c).isupper() else 2 if chr(_c).islower() else 0 if chr(_c).isdigit() else 1
_kind[128:] = 2
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*!|~^=+<>@_\\")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The labellers' measures, a row for each text."""
    starts, ends, rows = textvec.words(data, offsets)
    n = np.diff(rows)
    total = np.maximum(n, 1)
    kind = _kind[data]
    if len(data):  # capitals of Latin-1, in UTF-8
        kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = 3
    first_byte = (data & 0xC0) != 0x80

    def by_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[off[1:]] - sums[off[:-1]]

    ink = by_row(textvec.INK[data] & first_byte, offsets)
    capitals = by_row(kind == 3, offsets)
    letters = by_row((kind == 2) & first_byte, offsets) + capitals
    last = data[ends - 1]
    lettered = np.concatenate(([0], np.cumsum(kind >= 2)))
    h = textvec.segment_hash(data, starts, ends)
    repeat = np.zeros(len(n))
    for lag in range(1, 9):
        same = np.zeros(len(h), bool)
        same[lag:] = h[lag:] == h[:-lag]
        away = np.arange(len(h)) - np.repeat(rows[:-1], n) >= lag
        repeat = np.maximum(repeat, by_row(same & away, rows) / total)
    return np.stack([
        by_row(_MARK[last], rows) / total, by_row(kind == 1, offsets) / np.maximum(ink, 1),
        capitals / np.maximum(letters, 1), repeat, by_row(lettered[ends] == lettered[starts], rows) / total,
        by_row(_STOP[last], rows) / total, letters / total, n.astype(float)], axis=1)


def votes(m: np.ndarray) -> np.ndarray:
    """0 nothing, 1 bad, 2 good, for each text and labeller."""
    out = np.zeros(m.shape, np.int64)
    for k, (_, low, high, good_from, good_to) in enumerate(LABELLERS):
        x = m[:, k]
        out[(x >= good_from) & (x < good_to), k] = 2
        if low is not None:
            out[x < low, k] = 1
        if high is not None:
            out[x >= high, k] = 1
    out[m[:, -1] < VOTE_WORDS, :-1] = 0
    return out


_POWERS = 3 ** np.arange(len(LABELLERS))


def fit_votes(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of 0, 1, 2) and their counts. Texts are of
    one of these classes: good, or with the fault that a labeller looks for (as faults mostly
    exclude each other, votes are not independent on bad texts as a whole, but nearly so on those of
    one fault). Returns the chance that each pattern is good; the chances of the votes (class,
    labeller, vote), class 0 good; the shares of the classes. Starts from what the labellers say."""
    n, weight = len(LABELLERS), counts.astype(float)
    bad = (patterns == 1) * np.where(np.arange(n) < 5, START[0], START[1])
    fault = bad.max(axis=1, initial=0)
    of = np.column_stack((1 - fault, bad * (fault / np.maximum(bad.sum(axis=1), 1e-9))[:, None]))
    for _ in range(ROUNDS):
        mass = of * weight[:, None]
        share = (mass.sum(axis=0) + 0.1) / (mass.sum() + 0.1 * (n + 1))
        chance = np.stack([(mass.T @ (patterns == v)) for v in range(3)], axis=2) + 0.05
        chance[:, :, 0] = 0
        chance /= chance.sum(axis=2, keepdims=True)
        chance[:, :, 0] = 1  # no vote tells nothing
        log = np.log(share) + sum(np.log(chance[:, k, patterns[:, k]]).T for k in range(n))
        of = np.exp(log - log.max(axis=1, keepdims=True))
        of /= of.sum(axis=1, keepdims=True)
    return of[:, 0], chance, share


def features(data: np.ndarray, offsets: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Hashed features (float32), a row of 2 ** BITS for each text."""
    n, width = len(offsets) - 1, 1 << BITS
    size = np.diff(offsets)
    out = np.zeros((n, width), np.float32)
    if len(data) > 2:
        b = data.astype(np.uint32)
        gram = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D))
        gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
        row = np.repeat(np.arange(n), size)[:-2]
        inside = np.arange(len(data) - 2) + 2 < np.repeat(offsets[1:], size)[:-2]
        found = np.bincount(row[inside] * width + gram[inside], minlength=n * width).reshape(n, width)
        out = np.sqrt(found / np.maximum(size - 2, 1)[:, None]).astype(np.float32)
    level = np.minimum((m[:, :-1] * np.array([16, 32, 16, 16, 16, 32, 1.5])).astype(int), _STEPS - 1)
    level = np.concatenate((level, np.minimum(np.log2(m[:, -1:] + 1).astype(int), _STEPS - 1)), axis=1)
    place = np.arange(len(LABELLERS)) * _STEPS + level  # a hash that is easy to read: place in the first buckets
    np.add.at(out, (np.arange(n)[:, None], place), np.float32(0.4))
    return out


def fit_linear(x: np.ndarray, good: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a logistic model of the chances `good`, by accelerated gradient descent."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    if not len(x):
        return w
    step = 1.0 / (0.25 * ((x * x).sum(axis=1).max() + 1) + ridge)
    ahead, before = w.copy(), w
    for k in range(rounds):
        off = 1 / (1 + np.exp(-(x @ ahead[:-1] + ahead[-1]))) - good
        slope = np.append(x.T @ off.astype(np.float32) / len(x) + ridge * ahead[:-1], off.mean()).astype(np.float32)
        w = ahead - np.float32(step) * slope
        ahead, before = w + np.float32(k / (k + 3)) * (w - before), w
    return w


class Model:
    def __init__(self, patterns: dict[int, float], weights: np.ndarray):
        self.patterns, self.weights = patterns, weights


def _measured(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(batch.column(at))
    m = measures(data, offsets)
    return data, offsets, m, votes(m) @ _POWERS


def fit(docs: DataFrame) -> Model:
    """The weak-label model over all of `docs`, and the scorer fitted on a sample of it."""
    text = docs.select(text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in steps(batches):
            np.add.at(sums, _measured(batch, 0)[3], 1)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["pattern", "n"])

    found = text.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    codes = np.array(sorted(r["pattern"] for r in found), np.int64)
    counts = dict((r["pattern"], r["n"]) for r in found)
    counts = np.array([counts[c] for c in codes], np.int64)
    good, _, _ = fit_votes(codes[:, None] // _POWERS % 3, counts)
    patterns = dict(zip(codes.tolist(), good.tolist(), strict=True))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets, m, code = _measured(batch, 0)
            x = features(data, offsets, m).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["pattern", "x"])

    total = int(counts.sum())
    bound = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 40))
    chosen = (docs.select(text_or_empty().alias("text"), F.xxhash64(F.lit(7), F.col("doc_id"), text_or_empty()).alias("h"))
              .filter(F.pmod("h", F.lit(1 << 40)) < bound).dropDuplicates(["h"]).orderBy("h"))  # repeated rows once
    rows = chosen.select("text").mapInArrow(sample, "pattern long, x binary").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), 1 << BITS)
    return Model(patterns, fit_linear(x, np.array([patterns[r["pattern"]] for r in rows])))


def _scores(model: Model, batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets, m, code = _measured(batch, at)
    # Summed row by row, so that a score doesn't depend on the rows beside it.
    x = (features(data, offsets, m) * model.weights[:-1]).sum(axis=1, dtype=np.float64) + model.weights[-1]
    return 1 / (1 + np.exp(-x)), np.array([model.patterns[c] for c in code.tolist()]), code


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """For each row of `docs`: doc_id, votes_bad, votes_good, posterior (the chance that the votes
    give), score (that of the linear scorer), keep."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            score, posterior, code = _scores(model, batch, 1)
            said = code[:, None] // _POWERS % 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((said == 1).sum(axis=1)), pa.array((said == 2).sum(axis=1)),
                 pa.array(posterior), pa.array(score), pa.array(score >= KEEP)],
                names=["doc_id", "votes_bad", "votes_good", "posterior", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, votes_bad long, votes_good long, posterior double, score double, keep boolean")


def without_rejected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all their columns."""
    model = model or fit(docs)
    names, searched = docs.columns, fresh(docs, "_searched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, searched):
            score, _, _ = _scores(model, batch, len(names))
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
            yield kept.filter(pa.array(score >= KEEP))

    return docs.withColumn(searched, text_or_empty()).mapInArrow(run, docs.schema)
