"""Document fingerprints: homomorphic multiset hash.

Each paragraph (a line with at least one word) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two. So the order of the
paragraphs doesn't matter, equal multisets of paragraphs have equal fingerprints, and a paragraph
is inserted or deleted by adding or subtracting its vector.

The vector has two parts. `EXACT` uniform coordinates modulo 2**32 of the whole paragraph decide
equality (different multisets agree with a chance of about 2**-64 for any single pair, as the
paragraph's hash has 64 bits). `LIKE` coordinates modulo 2**16 hold a signed count sketch of its
five-word shingles (a shorter paragraph is one shingle): the squared length of a difference of two
fingerprints estimates in how many shingles the documents differ.

Defined cases: a null or empty text, or one of white space only, has the zero vector; the likeness
of equal fingerprints is 1; repeated rows get equal fingerprints; a table without rows gives none.
Other columns of the input, of any name, are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm import textvec
from fanscope.llm.common import parallelism, steps, text_or_empty, utf8

EXACT, LIKE = 64, 512
_SALT = textvec.salts(EXACT, 11)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint vectors (int64, reduced) of the rows of a string column."""
    n = len(offsets) - 1
    starts, ends, para_rows = textvec.segments(data != 10, offsets)
    ink = textvec.INK[data]
    if len(starts):  # paragraphs without a word don't count; white space at either end neither
        word_start, word_end, in_para = textvec.segments(ink, np.append(starts, len(data)))
        has = np.diff(in_para) > 0
        kept = np.flatnonzero(has)
        starts, ends = word_start[in_para[kept]], word_end[in_para[kept + 1] - 1]
        para_rows = np.concatenate(([0], np.cumsum(has)))[para_rows]
        rows = np.append(in_para[kept], len(word_start))
        word = textvec.segment_hash(data, word_start, word_end)
    else:
        rows, word = np.zeros(1, np.int64), np.zeros(0, np.uint64)
    para = textvec.segment_hash(data, starts, ends)
    out = np.zeros((n, EXACT + LIKE), np.int64)
    if len(para):
        for k in range(EXACT):
            wide = textvec.mix(para * _SALT[k] + np.uint64(k)) >> np.uint64(32)
            out[:, k] = textvec.reduce_rows(np.add, wide.astype(np.int64), para_rows, 0)
        shingle, para_off = textvec.shingles(word, rows)
        doc = np.repeat(np.repeat(np.arange(n), np.diff(para_rows)), np.diff(para_off))
        bucket = (shingle >> np.uint64(8)).astype(np.int64) & (LIKE - 1)
        sign = 1.0 - 2.0 * (shingle >> np.uint64(63))
        sketch = np.bincount(doc * LIKE + bucket, weights=sign, minlength=n * LIKE)
        out[:, EXACT:] = sketch.astype(np.int64).reshape(n, LIKE)
    return reduced(out)


def reduced(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    v[..., :EXACT] &= 0xFFFFFFFF
    v[..., EXACT:] = ((v[..., EXACT:] + 32768) & 0xFFFF) - 32768
    return v


def encoded(v: np.ndarray) -> list[str]:
    """A printable form: base64 of little-endian coordinates."""
    exact, like = v[:, :EXACT].astype("<u4"), v[:, EXACT:].astype("<i2")
    return [base64.b64encode(a.tobytes() + b.tobytes()).decode() for a, b in zip(exact, like, strict=True)]


def decoded(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint)
    return np.concatenate((np.frombuffer(raw[:4 * EXACT], "<u4").astype(np.int64),
                           np.frombuffer(raw[4 * EXACT:], "<i2").astype(np.int64)))


def text_vectors(texts: list[str | None]) -> np.ndarray:
    return vectors(*utf8(pa.array(texts, pa.string())))


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after the paragraph (or several, one a line) is added to its document."""
    return encoded(reduced(decoded(fingerprint) + text_vectors([paragraph])[0])[None])[0]


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after the paragraph is taken from its document."""
    return encoded(reduced(decoded(fingerprint) - text_vectors([paragraph])[0])[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of shingles in common (Dice, 0 to 1), estimated from the vectors of rows of a and b."""
    same = (a == b).all(axis=1)
    x, y = a[:, EXACT:].astype(np.float64), b[:, EXACT:].astype(np.float64)
    norm = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    apart = reduced(a - b)[:, EXACT:].astype(np.float64)
    share = 1.0 - (apart * apart).sum(axis=1) / np.where(norm > 0, norm, 1.0)
    return np.where(same, 1.0, np.where(norm > 0, np.clip(share, 0.0, 1.0), 0.0))


def document_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of each row's text in a new column `out` (replaced if it exists)."""
    schema = df.drop(out).schema.add(out, "string")
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            made = pa.array(encoded(vectors(*utf8(column))), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [made],
                                             names=[*keep, out])

    return df.mapInArrow(run, schema)


def _with_next(docs: DataFrame, slices: int) -> DataFrame:
    """Rows (slice, last, doc_id, text) such that, sorted by slice, last, descending doc_id and text
    hash, each row is followed by its next document. The rows are cut into slices of near equal
    size by quantiles of doc_id; a slice ends with a copy (`last`) of the first row of the slice
    that follows, and the last slice with the first row of all."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    at = [k / slices for k in range(1, slices)]
    bounds = keyed.agg(F.percentile_approx("doc_id", at, 10 * slices).alias("b")).first()["b"] if at else []
    bounds = sorted(set(bounds or []))
    above = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"),
                            lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    keyed = (keyed.withColumn("slice", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(above).cast("int"))
             .withColumn("h", F.xxhash64("text")))
    # One row for each slice comes to the driver.
    heads = sorted(keyed.groupBy("slice").agg(F.max(F.struct("doc_id", "h")).alias("m")).collect(),
                   key=lambda r: r["slice"])
    if not heads:
        return keyed.withColumn("last", F.lit(0))
    first = [(heads[k - 1]["slice"], r["slice"], r["m"]["doc_id"], r["m"]["h"]) for k, r in enumerate(heads)]
    first = spark.createDataFrame(first, "before int, s int, d long, hh long")
    same = (F.col("slice") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))
    ends = (keyed.join(F.broadcast(first), same)
            .select("doc_id", "text", F.col("before").alias("slice"), "h", F.lit(1).alias("last")))
    return keyed.withColumn("last", F.lit(0)).unionByName(ends)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, in descending doc_id; after the last comes the first. Rows without
    a doc_id come last; rows of equal doc_id are ordered by a hash of their text. The texts are
    shuffled once, and each task streams over its slices holding one step of rows at a time."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    dealt = (_with_next(docs, 2 * parts).repartition(parts, "slice")
             .sortWithinPartitions("slice", "last", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
             .select("slice", "last", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: slice, last, doc_id, text, vector
        for batch in steps(batches):
            part, last, ids = (batch.column(k).to_pylist() for k in range(3))
            texts, vec = batch.column(3).to_pylist(), vectors(*utf8(batch.column(3)))
            if held:
                part, last, ids, texts = ([h, *x] for h, x in zip(held, (part, last, ids, texts), strict=False))
                vec = np.concatenate((held[4][None], vec))
            have = [k for k in range(len(ids) - 1) if not last[k] and part[k] == part[k + 1]]
            held = part[-1], last[-1], ids[-1], texts[-1], vec[-1]
            if not have:
                continue
            edited = [texts[k][:len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][:len(texts[k]) // 2] for k in have]
            made, at = text_vectors(edited), np.array(have)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[k] for k in have], pa.int64()),
                "n_chars": pa.array([len(texts[k]) for k in have], pa.int64()),
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": encoded(vec[at]), "edited_fingerprint": encoded(made),
                "near_edited": likeness(vec[at], made), "near_next": likeness(vec[at], vec[at + 1])})

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
