"""Token-ID / binary output: whole texts to ids, ids to files of coded blocks, and back.

Texts are encoded by a public tokenizer with a fixed vocabulary and end with `END`. Ids are written
in ascending doc_id, in a table of segments: part, segment, doc_ids, lengths, n_ids, and the ids in
the blocks of `id_coder`. Part and segment give the order. Segments end with a document, and hold
`SEGMENT` ids or one document more.

The tokenizer splits at white space before all else, so each distinct run without ASCII white space
is encoded once a worker (up to `KEPT` are remembered) and looked up after that; the ids are those of
the whole text. Runs are found, and ids put together, for all texts of a batch at once.

Scale: texts are shuffled once, by ranges of doc_id. Reading back needs no shuffle; where a document
starts is found from the segments' sizes, first in their part, then over parts (a row for each part).

Defined cases: a null or empty text is the end id alone; rows without a doc_id come first; rows of
equal doc_id are ordered by a hash of their text; a table without rows gives no files and none
back; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanscope.llm import id_coder
from fanscope.llm.common import parallelism, scratch_path, steps, text_or_empty, utf8
from fanscope.llm.known_runs import KnownRuns, Runs
from fanscope.llm.textvec import segments

END, SEGMENT, KEPT = 2, id_coder.BLOCK * id_coder.LANES, 1 << 20
#: Signs at the end of a run that are cut off at most.
SIGNS = 8
FILES = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids long, data binary"


# The characters that byte-level vocabularies show bytes as: printable ones as
# themselves, the others, in order, as those from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[b for b in range(256) if b not in _PRINTED]] = 256 + np.arange(256 - len(_PRINTED))
_SHOWN[10] = 10  # parts words

_BYTES = np.arange(256, dtype=np.uint8)
_ALNUM = ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))
#: ASCII punctuation but the apostrophe.
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM & ~((_BYTES >= 65) & (_BYTES <= 90)) & (_BYTES != 39)


class Encoder:
    """Encodes texts by a tokenizer file, and remembers the ids of runs without white space.

    The tokenizer lowers case, and cuts signs off the end of a word before it merges. So case is
    lowered and signs are cut off here already where they follow an ASCII letter or digit (not
    apostrophes, as it knows 's and the like), which leaves fewer different runs. Texts that may
    hold names of special tokens stay as they are. A run of letters that the tokenizer neither changes
    nor cuts is one word and goes straight to the merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        # The Latin letters of which this is so, found by trying them.
        latin = [c for c in map(chr, range(97, 0x250)) if c.isalpha()]
        tried = self.tokenizer.encode_batch_fast([f"a{c}{c}b" for c in latin], add_special_tokens=False)
        self.letters = frozenset(c for c, e in zip(latin, tried, strict=True) if e.ids == self.merge([f"a{c}{c}b".encode()])[0])
        self.known = KnownRuns()

    def merge(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of words (without line feeds), one after the other, and how many each has."""
        shown = _SHOWN[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split("\n") if words else []
        ids, size, tokenize = [], [], self.tokenizer.model.tokenize
        for word in shown:
            tokens = tokenize(word)
            ids += [t.id for t in tokens]
            size.append(len(tokens))
        return ids, size

    def _learn(self, runs: list[bytes]) -> tuple[np.ndarray, list[int], list[int]]:
        """An order of these runs, the ids of all in that order, and how many each has."""
        plain = np.fromiter((self.letters.issuperset(r.decode()) for r in runs), bool, len(runs))
        ids, size = self.merge([r for r, p in zip(runs, plain, strict=True) if p])
        other = [r.decode() for r, p in zip(runs, plain, strict=True) if not p]
        for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False):
            ids += e.ids
            size.append(len(e))
        return np.argsort(~plain, kind="stable"), ids, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a string column, one after the other, and how many each text has."""
        runs, rows = _runs(*utf8(column))
        self.known.forget(KEPT)
        number = self.known.numbers(runs)
        new = np.flatnonzero(number == 0)
        if len(new):
            coded = runs.of(new).arrow().dictionary_encode()
            code = coded.indices.to_numpy()
            one = np.zeros(len(coded.dictionary), np.int64)
            one[code] = new  # a place of each
            order, *made = self._learn(coded.dictionary.to_pylist())
            numbers = np.empty(len(one), np.int64)
            numbers[order] = self.known.add(runs.of(one[order]), *made)
            number[new] = numbers[code]
        ids, end = self.known.ids_of(number)
        before = np.concatenate([[0], end])
        return ids, np.diff(before[rows])


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[Runs, np.ndarray]:
    """The runs in rows of UTF-8 bytes, and the offsets of each row's runs."""
    n = len(data)
    low = np.zeros((n // 8 + 2) * 8, np.uint8)
    np.left_shift(data - np.uint8(65) < 26, 5, out=low[:n], casting="unsafe", dtype=np.uint8)
    low[:n] |= data  # ASCII capitals made small
    # Rows that may hold names of special tokens.
    at = np.flatnonzero(data == 124)
    at = at[at > 0]
    special = np.unique(np.searchsorted(offsets, at[data[at - 1] == 60], "right") - 1)
    for r in special:
        low[offsets[r]:offsets[r + 1]] = data[offsets[r]:offsets[r + 1]]
    start, end, rows = segments((low[:n] != 32) & (low[:n] - np.uint8(9) > 4), offsets)
    # The signs at a run's end, if few, are a run of their own where an ASCII letter or digit is before them.
    plain = np.ones(len(start), bool)
    for r in special:
        plain[rows[r]:rows[r + 1]] = False
    run, at, cuts = np.flatnonzero(plain), end[plain], []
    for signs in range(SIGNS + 1):
        is_sign = _SIGN[low[at - 1]]
        if signs:
            stop = ~is_sign & _ALNUM[low[at - 1]]
            cuts.append((run[stop], at[stop]))
        go = is_sign & (at - 1 > start[run])
        run, at = run[go], at[go] - 1
    cut = np.zeros(len(start), np.int64)
    for run, at in cuts:
        cut[run] = at
    two = cut > 0
    place = np.arange(len(start)) + np.cumsum(two) - two
    starts, ends = np.empty(len(start) + int(two.sum()), np.int64), np.empty(len(start) + int(two.sum()), np.int64)
    starts[place], ends[place] = start, np.where(two, cut, end)
    starts[place[two] + 1], ends[place[two] + 1] = cut[two], end[two]
    return Runs(low, starts, ends - starts), np.append(place, len(starts))[rows]


_encoder: Encoder | None = None


def encoder(path: str) -> Encoder:
    """The worker's encoder: Spark reuses workers, so that tasks share it."""
    global _encoder
    if _encoder is None or _encoder.path != path:
        _encoder = Encoder(path)
    return _encoder


def write_ids(docs: DataFrame, to: str, tokenizer: str, end: int = END) -> None:
    """Encodes the texts of `docs` (doc_id, text) and writes the files to the folder `to`."""
    parts = parallelism(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids, sizes, data, n = [], [], [], 0

        def record() -> pa.RecordBatch:
            coded = id_coder.encode(np.concatenate(data))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([coded], pa.binary())],
                names=["part", "segment", "doc_ids", "lengths", "n_ids", "data"])

        for batch in steps(batches):
            ids, size = encoder(tokenizer).encode(batch.column(1))
            stop = np.cumsum(size)
            pieces = [np.array([end], np.uint32)] * (2 * len(size))
            pieces[::2] = np.split(ids, stop[:-1])
            ids = np.concatenate(pieces)
            at, stop = 0, np.cumsum(size + 1)
            known = batch.column(0).to_pylist()
            while at < len(stop):
                # Documents up to the one that fills the segment.
                done = int(stop[at - 1]) if at else 0
                to_doc = min(int(np.searchsorted(stop, done + SEGMENT - n)) + 1, len(stop))
                doc_ids += known[at:to_doc]
                sizes += (size[at:to_doc] + 1).tolist()
                data.append(ids[done:stop[to_doc - 1]])
                n += len(data[-1])
                at = to_doc
                if n >= SEGMENT:
                    yield record()
                    doc_ids, sizes, data, n, segment = [], [], [], 0, segment + 1
        if doc_ids:
            yield record()

    rows.mapInArrow(run, FILES).write.parquet(to)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, nth (in the segment), doc_id, ids (array of 32-bit numbers, as bytes), n_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, segment, doc_ids, size, ids in _decoded(batches):
            end = np.cumsum(size)
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part, np.int32)), pa.array(np.full(len(size), segment, np.int32)),
                 pa.array(np.arange(len(size))), pa.array(doc_ids, pa.int64()),
                 pa.array([raw[4 * (e - n):4 * e] for n, e in zip(size, end, strict=True)], pa.binary()), pa.array(size)],
                names=["part", "segment", "nth", "doc_id", "ids", "n_tokens"])

    files = spark.read.schema(FILES).parquet(path)
    return files.mapInArrow(run, "part int, segment int, nth long, doc_id long, ids binary, n_tokens long")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):  # a segment at a time
            part, segment, doc_ids, sizes, _, data = (c[k].as_py() for c in batch.columns)
            yield part, segment, doc_ids, np.array(sizes, np.int64), id_coder.decode(data)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, segment, doc_ids, size, ids in _decoded(batches):
            end = np.cumsum(size)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(size.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part, np.int32)), pa.array(np.full(len(size), segment, np.int32)),
                 pa.array(doc_ids, pa.int64()), pa.array(end - size), pa.array(size), pa.array(crc, pa.int64())],
                names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILES).parquet(path)
    sizes = files.select("part", "segment", "n_ids")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("part_at"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("segment_at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
              .select("part", "segment", (F.col("part_at") + F.col("segment_at")).alias("segment_at")))
    made = files.mapInArrow(run, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (made.join(starts, ["part", "segment"])
            .select("doc_id", (F.col("segment_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def written_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files of `docs` to shared storage and returns their digest()."""
    to = scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, to, tokenizer)
    return digest(docs.sparkSession, to)
