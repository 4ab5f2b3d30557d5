"""Benchmark decontamination: spaced-seed hashing.

Fixed masks over `SPAN` tokens ignore some positions, so a window still hits if tokens were
substituted there. The hashes of the benchmark's windows are joined with those of the documents'.
A hit fixes a diagonal (document position minus item position); along it the tokens are compared.
The best run (a match counts 1, a substitution costs `COST`) is a leak if it has `MATCH` matching
tokens, or `SHARE` of all tokens of a shorter item; so is all from the first to the last match, if
`SHARE` of the item's tokens match. The one with more matches is returned (ties: the run).

Wherever `SPAN` or more successive tokens keep `SHARE` of theirs, a mask hits, whichever tokens were
substituted. Runs that keep fewer (`MATCH` tokens with up to one in three substituted) are leaks if
a mask hits, which it need not. Inserted or dropped tokens end a diagonal.

Tokens are runs of characters other than ASCII white space and punctuation, in lower case. Items of
fewer than `SPAN` tokens are searched whole and without substitutions.

Scale: documents are read once and nothing of them is shuffled while the benchmark is small
(`BROADCAST_BYTES` of text, checked): its seeds then go to all tasks. A larger benchmark's seeds
are joined with the documents' by a shuffle; a very frequent seed is split by AQE.

Defined cases: null and empty texts and items never match; an item that repeats is found under each
item_id; of several runs of one item in a document the best is returned (ties: the first);
repeated documents are each returned; tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm import textvec
from fanscope.llm.common import fresh, steps, text_or_empty, utf8

#: Positions of a window of SPAN tokens that each mask compares. Any two substitutions in a window are
#: ignored by at least one mask, and at some place of n >= SPAN tokens any n // 5 (found by search).
SPAN = 12
MASKS = ((0, 1, 4, 8, 10, 11), (0, 2, 3, 5, 10, 11), (1, 5, 6, 7, 9, 10), (1, 2, 3, 4, 6, 8), (0, 2, 6, 7, 9, 11),
         (3, 4, 5, 7, 8, 9))
MATCH, SHARE, COST = 13, 0.8, 2
BROADCAST_BYTES = 4 << 20
#: Seed hits that are held at once, and compared tokens.
HITS = 1 << 20

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOKEN = textvec.INK.copy()
TOKEN[list(_SIGNS)] = False
_FACTOR = textvec.salts(SPAN, 10)
_MASK_SALT = textvec.salts(len(MASKS) + SPAN, 12)
HIT = ("doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_matched long, "
       "item_tokens long, coverage double")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a string column, and the offsets of each row's."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends, rows = textvec.segments(TOKEN[data], offsets)
    return textvec.segment_hash(data, starts, ends), rows


def seeds(h: np.ndarray, rows: np.ndarray, short: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask (then for each length in `short`) positions in `h` and hashes of the windows there."""
    last = np.repeat(rows[1:], np.diff(rows))
    plans = [(SPAN, m, k) for k, m in enumerate(MASKS)] + [(n, range(n), len(MASKS) + n) for n in short]
    for span, mask, k in plans:
        at = np.flatnonzero(np.arange(len(h)) + span <= last)
        value = np.zeros(len(at), np.uint64)
        whole = len(at) and len(at) == at[-1] + 1  # no gaps: plain slices will do
        for p in mask:
            value += (h[p:len(at) + p] if whole else h[at + p]) * _FACTOR[p]
        yield at, textvec.mix(value ^ _MASK_SALT[k])


class Bench:
    """The benchmark's tokens and sorted seeds. Items of equal tokens are searched once."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        h, rows = tokens(pa.array(texts, pa.string()))
        same: dict[bytes, list[int]] = {}
        for k in range(len(ids)):
            same.setdefault(h[rows[k]:rows[k + 1]].tobytes(), []).append(k)
        self.same = list(same.values())
        self.h = np.concatenate([np.zeros(0, np.uint64), *(h[rows[k[0]]:rows[k[0] + 1]] for k in self.same)])
        self.rows = np.concatenate([[0], np.cumsum([rows[k[0] + 1] - rows[k[0]] for k in self.same])]).astype(np.int64)
        size = np.diff(self.rows)
        self.short = sorted({int(n) for n in size if 0 < n < SPAN})
        item = np.repeat(np.arange(len(self.same)), size)
        found = []
        for k, (at, value) in enumerate(seeds(self.h, self.rows, self.short)):
            if k >= len(MASKS):  # a short item as a whole, no part of a longer one
                own = size[item[at]] == self.short[k - len(MASKS)]
                at, value = at[own], value[own]
            found.append((value, at))
        value, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(value, kind="stable")
        self.value, self.at, self.item = value[order], at[order], item
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.value >> np.uint64(44)] = True

    def hits(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and diagonals of all seed hits, each once, in order; positions count from the start
        of row and item. No more than about `HITS` hits are held beside the different ones."""
        found = [np.zeros((0, 3), np.int64)]
        for at, value in seeds(h, rows, self.short) if len(self.value) else ():
            near = np.flatnonzero(self.seen[value >> np.uint64(44)])
            low = np.searchsorted(self.value, value[near], "left")
            n = np.searchsorted(self.value, value[near], "right") - low
            near, low, n = near[n > 0], low[n > 0], n[n > 0]
            cut = np.searchsorted(np.cumsum(n), np.arange(HITS, int(n.sum()) + HITS, HITS))
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(near)], strict=True):
                own, first = n[a:b], low[a:b]
                pos = np.repeat(at[near[a:b]], own)
                seed = self.at[np.arange(int(own.sum())) + np.repeat(first - (np.cumsum(own) - own), own)]
                row, item = np.searchsorted(rows, pos, "right") - 1, self.item[seed]
                if len(pos):
                    found.append(_different(row, item, (pos - rows[row]) - (seed - self.rows[item])))
        return tuple(_different(*np.concatenate(found).T).T)

    def leaks(self, h: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int, int]]:
        """By (row, item): document start, item start, tokens, matching tokens, tokens of the item."""
        out: dict = {}
        row, item, diagonal = self.hits(h, rows)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)])) if len(row) else row
        for a, b in zip(new, np.append(new, len(row))[1:], strict=True):
            r, i = int(row[a]), int(item[a])
            own = self.h[self.rows[i]:self.rows[i + 1]]
            if run := best_of(h[rows[r]:rows[r + 1]], own, diagonal[a:b]):
                out |= {(r, k): (*run, len(own)) for k in self.same[i]}
        return out


def _different(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The different triples, in order, as rows."""
    order = np.lexsort((diagonal, item, row))
    triples = np.column_stack((row, item, diagonal))[order].astype(np.int64)
    new = np.ones(len(triples), bool)
    new[1:] = (triples[1:] != triples[:-1]).any(axis=1)
    return triples[new]


def best_of(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int] | None:
    """The best of best_run() over diagonals (ascending; of equal ones the first). A diagonal can't be the
    best one if it holds fewer matches than the best so far, so the others are looked at by their
    matches, most first, which are counted for many diagonals at once."""
    if len(diagonals) == 1:
        return best_run(doc, item, int(diagonals[0]))
    matches, at = [], np.arange(len(item))
    step = max(1, HITS // max(1, len(item)))
    for k in range(0, len(diagonals), step):
        place = diagonals[k:k + step, None] + at
        there = (place >= 0) & (place < len(doc))
        matches.append(((doc[np.clip(place, 0, len(doc) - 1)] == item) & there).sum(axis=1))
    matches = np.concatenate(matches)
    best, of = None, -1
    order = np.lexsort((diagonals, -matches))
    for k in order[matches[order] >= _need(len(item))].tolist():
        if best and (matches[k] < best[3] or matches[k] == best[3] and diagonals[k] > of):
            if matches[k] < best[3]:
                break
            continue
        run = best_run(doc, item, int(diagonals[k]))
        if run and (not best or run[3] > best[3] or run[3] == best[3] and diagonals[k] < of):
            best, of = run, int(diagonals[k])
    return best


def _need(size: int) -> int:
    """Matches that a leak of an item of so many tokens has at least."""
    return size if size < SPAN else min(MATCH, int(np.ceil(SHARE * size)))


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """The best run of doc[diagonal + i] against item[i], or all matches there, if that is a leak."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[low + diagonal:high + diagonal] == item[low:high]
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -COST))))
    end = int(np.argmax(score - np.minimum.accumulate(score)))
    start = int(np.argmin(score[:end + 1]))
    matched = int(same[start:end].sum())
    need = _need(len(item))
    at = np.flatnonzero(same)
    if len(item) >= SPAN and len(at) > matched and len(at) >= SHARE * len(item) - 1e-9:
        start, end, matched = int(at[0]), int(at[-1]) + 1, len(at)
    return (low + start + diagonal, low + start, end - start, matched) if matched >= need else None


def _small(benchmark: DataFrame) -> Bench | None:
    """The benchmark's seeds, if its texts have BROADCAST_BYTES or fewer."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    if size > BROADCAST_BYTES:
        return None
    found = rows.collect()
    return Bench([r["item_id"] for r in found], [r["text"] for r in found])


def _record(leaks: list[tuple], ids: list, items: list) -> pa.RecordBatch:
    names = [f.split()[0] for f in HIT.split(", ")]
    rows = [(ids[r], items[i], a, b, n, m, size, m / size) for (r, i), (a, b, n, m, size) in leaks]
    kinds = [pa.int64()] * 7 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(8)], names=names)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that leaked into it: doc_id, item_id, doc_start and
    item_start (in tokens), n_tokens and n_matched of the run, item_tokens, coverage (n_matched /
    item_tokens). Documents without a leak have no row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bench = _small(benchmark)
    if bench is None:
        return _joined(rows, benchmark).drop("k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = bench.leaks(*tokens(batch.column(1)))
            if found:
                yield _record(sorted(found.items()), batch.column(0).to_pylist(), bench.ids)

    return rows.mapInArrow(run, HIT)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no leak, with all their columns."""
    bench = _small(benchmark)
    if bench is None:
        text, k1, k2 = text_or_empty(), fresh(docs, "_k1"), fresh(docs, "_k2")
        bad = _joined(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), benchmark)
        marked = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text)})
        return (marked.join(bad.select(F.col("k1").alias(k1), F.col("k2").alias(k2)), [k1, k2], "left_anti")
                .select(*docs.columns))
    names, searched = docs.columns, fresh(docs, "_searched")
    marked = docs.withColumn(searched, text_or_empty())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, searched):
            found = bench.leaks(*tokens(batch.column(len(names))))
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, _ in found]] = False
            if clean.any():
                kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
                yield kept if clean.all() else kept.filter(pa.array(clean))

    return marked.mapInArrow(run, docs.schema)


def _joined(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As leaks(), with the hashes k1 and k2 of the text: seeds are joined by a shuffle, then each
    text that was hit is compared with the items that hit it."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("item"))
    lengths = F.size(F.split(F.trim(F.regexp_replace("item", r"[\x09-\x0D\x20-\x2F:-@\[-`{-~]+", " ")), " "))
    short = sorted(r[0] for r in items.select(lengths.alias("n")).filter(f"n < {SPAN}").distinct().collect())

    def seeded(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "text"):
                h, off = tokens(batch.column(2))
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                size = np.diff(off)
                for k, (at, value) in enumerate(seeds(h, off, short)):
                    row = np.searchsorted(off, at, "right") - 1
                    if whole and k >= len(MASKS):
                        own = size[row] == short[k - len(MASKS)]
                        row, at, value = row[own], at[own], value[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (a[row], b[row], value.view(np.int64), at - off[row])],
                        names=["k1", "k2", "seed", "at"])
        return run

    kind = "k1 long, k2 long, seed long, at long"
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    of_docs = (keyed.select("k1", "k2", "text").mapInArrow(seeded(False), kind)
               .groupBy("k1", "k2", "seed", "at").agg(F.lit(1).alias("one")))
    keyed_items = items.select("item_id", "item", F.xxhash64("item").alias("i1"), F.xxhash64(F.lit(1), "item").alias("i2"))
    of_items = (keyed_items.select(F.col("i1").alias("k1"), F.col("i2").alias("k2"), F.col("item").alias("text"))
                .mapInArrow(seeded(True), kind).distinct()
                .select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "seed", F.col("at").alias("item_at")))
    hits = (of_docs.join(of_items, "seed").select("k1", "k2", "i1", "i2", (F.col("at") - F.col("item_at")).alias("d"))
            .groupBy("k1", "k2", "i1", "i2").agg(F.collect_set("d").alias("diagonals")))
    pairs = (hits.join(keyed_items, ["i1", "i2"]).select("k1", "k2", "item_id", "item", "diagonals")
             .join(keyed, ["k1", "k2"]).select("doc_id", "item_id", "k1", "k2", "text", "item", "diagonals"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            (h, off), (g, items_off) = tokens(batch.column(4)), tokens(batch.column(5))
            out = []
            for r, diagonals in enumerate(batch.column(6).to_pylist()):
                doc, item = h[off[r]:off[r + 1]], g[items_off[r]:items_off[r + 1]]
                if run := best_of(doc, item, np.sort(np.array(diagonals, np.int64))):
                    out.append(((r, r), (*run, len(item))))
            if out:
                made = _record(out, batch.column(0).to_pylist(), batch.column(1).to_pylist())
                at = pa.array([x[0][0] for x in out])
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column(2).take(at), batch.column(3).take(at)],
                                                 names=[*made.schema.names, "k1", "k2"])

    return pairs.mapInArrow(verify, HIT + ", k1 long, k2 long")
