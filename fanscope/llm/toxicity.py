"""Toxicity: nearest labelled examples by exact TF-IDF cosine.

A document's score comes from the `NEAREST` labelled examples with the highest TF-IDF cosine. Each
votes with its label, weighted by its similarity and by how many labelled rows it stands for; the
share of toxic votes is calibrated (a logistic curve, fitted on the examples with each left out of
its own vote). The nearest examples are returned as evidence.

Search is exact: examples lie in blocks, and an inverted index keeps for each term and block the
largest weight. The sum of a query's weights times these bounds every cosine in a block. Blocks are
scored in descending order of their bounds, until no bound exceeds the lowest similarity kept.

Terms are tokens in lower case (runs without white space and ASCII punctuation) and their first 4,
5 and 7 bytes. All terms of the examples count, or the `TERMS` whose presence depends most on the
label where there are more; no term is left out for a weak or rare dependence. A term's TF-IDF is
multiplied by its dependence (the root of chi-squared), less so if that is below what chance gives
the strongest of so many terms. Document frequencies are counted over all documents.

Examples are a bounded sample: about `EXAMPLES` rows, chosen by a hash of doc_id, half of them toxic
if there are as many. Labels come from rows whose crc32(doc_id) mod 5 isn't 0; nothing but the text
enters a score.

Scale: two passes over the texts (frequencies, scores) without a shuffle of documents. The driver
holds the examples' terms (about 40 MB), and tasks the index of at most `TERMS` x `EXAMPLES` weights
(bounds of `TERMS` x `EXAMPLES` / `BLOCK` blocks, about 12 MB); `ENTRIES` query weights at a time are
looked up.

Defined cases: a null or empty text, or one without a kept term, gets the score of the base rate;
rows with equal texts get equal scores; labels other than 0 and 1 and labels of missing documents
are ignored; without toxic examples every score is near 0; a table without rows gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanscope.llm import textvec
from fanscope.llm.common import steps, text_or_empty, utf8

EXAMPLES, TERMS = 3000, 1 << 14
NEAREST, BLOCK, EVIDENCE, ENTRIES = 32, 64, 3, 1 << 13
#: Bytes of the prefixes that are terms; the weight of the base rate beside the votes.
PREFIXES, BASE = (4, 5, 7), 0.05

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOKEN = textvec.INK.copy()
TOKEN[list(_SIGNS)] = False
_BYTE = textvec.salts(256, 31)
_PLACE = textvec.salts(max(PREFIXES), 32)
_KIND = textvec.salts(len(PREFIXES), 33)


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the terms of a string column and the rows they stand in, kind by kind."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends, rows = textvec.segments(TOKEN[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    yield textvec.segment_hash(data, starts, ends), row
    sums = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        long = ends - starts > k
        starts, ends, row, sums = starts[long], ends[long], row[long], sums[long]
        sums = sums + _BYTE[data[starts + k]] * _PLACE[k]
        if k + 1 in PREFIXES:
            yield textvec.mix(sums ^ _KIND[PREFIXES.index(k + 1)]), row


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by row: row, term and how often it stands there."""
    h, row = (np.concatenate(x) for x in zip(*terms(column), strict=True))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, int)
    return row[new], h[new], np.diff(np.append(new, len(h)))


class Vocabulary:
    """The kept terms, sorted; finds them in texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by row: row, number of the term, how often it stands there."""
        n = len(self.hashes)
        found = []
        for h, row in terms(column) if n else ():
            near = np.flatnonzero(self.seen[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, h[near]), n - 1)
            hit = self.hashes[at] == h[near]
            found.append(row[near[hit]] * n + at[hit])
        code, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int),) * 2
        return code // max(n, 1), code % max(n, 1), count


def weighted(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights, of length 1 for each row."""
    w = (1 + np.log(count)) * idf[term]
    length = np.sqrt(np.bincount(row, w * w, n))
    return w / np.maximum(length, 1e-300)[row]


class Index:
    """Block-max inverted index of examples (rows sorted; row, term, weight)."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray,
                 stands_for: np.ndarray, ids: list, n_terms: int):
        n = len(labels)
        # Examples that share their heaviest term lie together, which keeps the bounds of blocks tight.
        heaviest = np.full(n, n_terms)
        order = np.lexsort((weight, row))
        heaviest[row[order]] = term[order]
        place = np.argsort(heaviest, kind="stable")
        at = np.empty(n, int)
        at[place] = np.arange(n)
        self.labels, self.stands_for = labels[place], stands_for[place]
        self.ids, self.at = [ids[k] for k in place], at
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        doc = at[row]
        order = np.lexsort((doc, term, doc // BLOCK))
        doc, self.weight = doc[order], weight[order]
        self.slot = doc % BLOCK
        code = (doc // BLOCK) * n_terms + term[order]
        #: Postings of block b and term t: start[b * n_terms + t] up to the next start.
        self.start = np.searchsorted(code, np.arange(self.blocks * n_terms + 1))
        self.bound = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.bound, (term[order], doc // BLOCK), self.weight)
        self.n_terms = n_terms

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int,
                but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of n queries (sorted; row, term, weight) the examples with the highest cosines
        and these, in descending order; -1 where there are none above 0. Ties go to the lower
        place. `but`: an example for each query that is left out."""
        best, sim = np.full((n, NEAREST), -1), np.zeros((n, NEAREST))
        of_row, at = np.searchsorted(row, np.arange(n + 1)), 0
        while at < n:
            end = int(np.searchsorted(of_row, of_row[at] + ENTRIES, "right")) - 1
            end = min(max(end, at + 1), n)
            own = slice(of_row[at], of_row[end])
            best[at:end], sim[at:end] = self._nearest(row[own] - at, term[own], weight[own], end - at,
                                                      None if but is None else but[at:end])
            at = end
        return best, sim

    def _nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int,
                 but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        bound = np.zeros((n, self.blocks))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            bound[row[first]] = np.add.reduceat(self.bound[term] * weight[:, None], first, axis=0)
        bound *= 1 + 1e-9  # sums of other order
        turn = np.argsort(-bound, axis=1, kind="stable")
        of_row = np.searchsorted(row, np.arange(n + 1))
        best, sim = np.full((n, NEAREST), -1), np.zeros((n, NEAREST))
        for k in range(self.blocks):
            block = turn[:, k]
            open_ = np.flatnonzero((bound[np.arange(n), block] >= sim[:, -1]) & (bound[np.arange(n), block] > 0))
            if not len(open_):
                break
            block, size = block[open_], np.diff(of_row)[open_]
            entry = np.arange(int(size.sum())) + np.repeat(of_row[open_] - (np.cumsum(size) - size), size)
            local = np.repeat(np.arange(len(open_)), size)
            code = block[local] * self.n_terms + term[entry]
            low, many = self.start[code], self.start[code + 1] - self.start[code]
            some = np.flatnonzero(many)
            local, entry, low, many = local[some], entry[some], low[some], many[some]
            of = np.repeat(np.arange(len(some)), many)
            post = np.arange(len(of)) + (low - (np.cumsum(many) - many))[of]
            cos = np.bincount((local * BLOCK)[of] + self.slot[post], weight[entry][of] * self.weight[post], len(open_) * BLOCK)
            cos = cos.reshape(len(open_), BLOCK)
            example = block[:, None] * BLOCK + np.arange(BLOCK)
            if but is not None:
                cos[example == but[open_][:, None]] = 0
            example = np.where(cos > 0, example, -1)
            both, ex = np.hstack((sim[open_], cos)), np.hstack((best[open_], example))
            order = np.lexsort((ex, -both), axis=1)[:, :NEAREST]
            sim[open_] = np.take_along_axis(both, order, 1)
            best[open_] = np.take_along_axis(ex, order, 1)
        return best, sim

    def votes(self, best: np.ndarray, sim: np.ndarray, base: float) -> np.ndarray:
        """Share of toxic votes, with the base rate as a vote of weight BASE."""
        w = sim * np.where(best >= 0, self.stands_for[best], 0) / max(self.stands_for.mean(), 1e-300) if self.n else sim
        toxic = (w * self.labels[best]).sum(axis=1) if self.n else np.zeros(len(sim))
        return (toxic + BASE * base) / (w.sum(axis=1) + BASE)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, drawn to (1, 0), by Newton's method."""
    ab, prior, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1.0
    design = np.column_stack((x, np.ones_like(x)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * (ab - prior)
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(bend, slope)
        ab = ab + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return max(float(ab[0]), 0.01), float(ab[1])


class Model:
    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, index: Index, base: float, curve: tuple[float, float]):
        self.vocabulary, self.idf, self.index, self.base, self.curve = vocabulary, idf, index, base, curve

    def queries(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, term, count = self.vocabulary.find(column)
        return row, term, weighted(row, term, count, self.idf, len(column))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, sim = self.index.nearest(*self.queries(column), len(column))
        x = self.curve[0] * logit(self.index.votes(best, sim, self.base)) + self.curve[1]
        return 1 / (1 + np.exp(-x)), best, sim


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Sampled rows doc_id, toxic, text, and the number of labelled rows by label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic = min(counts.get(1, 0), EXAMPLES // 2)
    share = {1: toxic / max(counts.get(1, 0), 1), 0: min(1.0, (EXAMPLES - toxic) / max(counts.get(0, 0), 1))}
    bound = F.when(F.col("toxic") == 1, int(share[1] * (1 << 40))).otherwise(int(share[0] * (1 << 40)))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)) < bound)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # About EXAMPLES thin rows, as the sample's bound is a share of the counted rows.
    return text.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), counts


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The index of labelled examples, with document frequencies over all of `docs`."""
    examples, counts = _examples(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            row, h, n = _counted(batch.column(2))
            off = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [[x[off[k]:off[k + 1]].tobytes() for k in range(batch.num_rows)] for x in (h, n.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.binary()) for x in lists)],
                                             names=["doc_id", "toxic", "h", "n"])

    rows = examples.mapInArrow(count, "doc_id long, toxic int, h binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["h"]))
    labels_ = np.array([r["toxic"] for r in rows], int)
    hashes = [np.frombuffer(r["h"], np.uint64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in hashes])
    h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    times = np.concatenate([*(np.frombuffer(r["n"], np.uint32) for r in rows), np.zeros(0, np.uint32)])
    hashes, dependence = _dependent(h, labels_[row] if len(rows) else np.zeros(0, int), labels_)
    vocabulary = Vocabulary(hashes)
    n = len(vocabulary.hashes)
    at = np.minimum(np.searchsorted(vocabulary.hashes, h), max(n - 1, 0))
    kept = vocabulary.hashes[at] == h if n else np.zeros(len(h), bool)
    row, term, times = row[kept], at[kept], times[kept]
    order = np.lexsort((term, row))
    row, term, times = row[order], term[order], times[order]

    total, often = _frequencies(docs, vocabulary)
    idf = (np.log((1 + total) / (1 + often)) + 1e-3) * dependence
    weight = weighted(row, term, times, idf, len(rows))
    sampled = np.bincount(labels_, minlength=2)
    stands_for = np.array([counts.get(v, 0) / max(sampled[v], 1) for v in (0, 1)])[labels_] if len(rows) else np.zeros(0)
    base = (counts.get(1, 0) + 0.01) / (sum(counts.values()) + 1)
    index = Index(row, term, weight, labels_, stands_for, [r["doc_id"] for r in rows], n)
    best, sim = index.nearest(row, term, weight, len(rows), but=index.at)
    share = index.votes(best, sim, base)
    return Model(vocabulary, idf, index, base, fit_curve(logit(share), labels_, stands_for))


def _dependent(h: np.ndarray, label: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TERMS terms whose presence depends most on the label, sorted, and how much. Chi-squared is
    the mean of that of all examples and that without one example that speaks for the dependence, so
    that terms of one or two examples count less, but do count."""
    term, code = np.unique(h, return_inverse=True)
    here = np.bincount(code, minlength=len(term)).astype(float)
    toxic = np.bincount(code, label, len(term))
    n, n1 = float(len(labels)), float(labels.sum())

    def chi(here: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        spread = here * (n - here) * n1 * (n - n1) / max(n, 1) ** 3
        return np.where(spread > 0, (toxic - here * n1 / max(n, 1)) ** 2 / np.maximum(spread, 1e-300), 0)

    whole, less = chi(here, toxic), chi(here - 1, toxic - (toxic * n > here * n1))
    mean = (whole + np.minimum(whole, less)) / 2
    kept = np.sort(np.lexsort((term, -mean))[:TERMS])
    # About the highest chi-squared that chance gives among so many terms.
    chance = 2 * np.log(max(len(term), 2))
    # Terms that stand in all examples or in labels of one kind depend on nothing; they keep a trace.
    return term[kept], np.sqrt(mean[kept]) * np.minimum(1, mean[kept] / chance) + 1e-6


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of documents, and for each term the number it stands in; one small row a task and term."""
    n = len(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n + 1, np.int64)
        for batch in steps(batches):
            sums[:n] += np.bincount(vocabulary.find(batch.column(0))[1], minlength=n)
            sums[n] += batch.num_rows
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "n"])

    found = (docs.select(text_or_empty().alias("text")).mapInArrow(run, "term long, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(n + 1, np.int64)
    for r in found:
        out[r["term"]] = r["n"]
    return int(out[n]), out[:n]


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, held_out, score, predicted (score >= 0.5),
    evidence (the nearest examples: doc_id, toxic, similarity)."""
    model = model or fit(docs, labels)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            score, best, sim = model.scores(batch.column(2))
            evidence = [[(model.index.ids[k], int(model.index.labels[k]), s) for k, s in zip(b, c, strict=True) if k >= 0]
                        for b, c in zip(best[:, :EVIDENCE].tolist(), sim[:, :EVIDENCE].tolist(), strict=True)]
            evidence = [[{"doc_id": a, "toxic": b, "similarity": c} for a, b, c in x] for x in evidence]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array(evidence, kind)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, "
                                "evidence array<struct<doc_id:bigint,toxic:int,similarity:double>>")
