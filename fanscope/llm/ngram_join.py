"""N-gram Jaccard join: MinHash LSH forest with exact verification.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of `SIMILAR` or
more; classes are the connected components of the links. A text of fewer words has one shingle of
all of them; texts without words are linked to equal texts only. Equal texts are always linked.

1. Equal texts collapse to one row with `TREES * DEPTH` MinHash values, made where texts are read.
2. A tree is a trie over a text's `DEPTH` values, kept as rows sorted by label. Matched prefixes are
   shortened from `DEPTH` until the trees together find a pair at the threshold with a chance of
   `RECALL` (`prefix_length`); texts that share such a prefix are a node of the trie. Rows are
   range-partitioned by the whole label, so a crowded node is cut by longer prefixes and spread over
   tasks. Within a node, texts whose signatures are alike enough (`ALIKE`, far below the threshold)
   are joined; pieces of a cut node are joined as a whole. This only proposes: components of these
   edges hold every link, and texts of different components are never compared.
3. Each proposed component's shingle sets come together once, in blocks of bounded size; each block
   and pair of blocks is verified exactly, by products of the shingle incidence matrix. That gives
   every text's number of links and the classes.

Scale: only texts in proposed components move their shingles. A component of any size is spread by
hash over blocks of about `BLOCK` shingles, so a task holds two blocks at most. No pair is ever a
row. The driver sees counts only.

Defined cases: a null text counts as empty; rows with equal text, repeated doc_ids or none are
documents of their own; class_id is the smallest doc_id of the class, null if it has none; a table
without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm import textvec
from fanscope.llm.common import fresh, parallelism, steps, text_or_empty, utf8, written
from fanscope.llm.components import connected_components

SIMILAR, WORDS = Fraction(4, 5), 5
TREES, DEPTH, RECALL = 16, 6, 0.9995
#: Share of equal signature values from which texts of a node are joined: five standard errors
#: below SIMILAR.
ALIKE = 0.55
#: Rows of a node that are compared with each other at once; weight of a block (its shingles, but
#: LEAST for each text at least); candidates that are broadcast (32 bytes each).
NODE_ROWS, BLOCK, LEAST, BROADCAST_ROWS = 1024, 1 << 20, 256, 200_000
_SALT = textvec.salts(TREES * DEPTH, 8)


def prefix_length(similar: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, at most `depth`, with which `trees` trees find a pair of similarity
    `similar` with a chance of `recall` or more; 1 if none does."""
    length = depth
    while length > 1 and 1 - (1 - similar ** length) ** trees < recall:
        length -= 1
    return length


PREFIX = prefix_length(float(SIMILAR), TREES, DEPTH, RECALL)


def signatures(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """MinHash values (uint32, a row of TREES * DEPTH) of each row's shingles."""
    out = np.zeros((len(rows) - 1, TREES * DEPTH), np.uint32)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        for k in range(TREES * DEPTH):
            out[full, k] = np.minimum.reduceat(h * _SALT[k], rows[full]) >> np.uint64(32)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    """One row for each different text: id, k1, k2, first_doc, copies, n (shingles), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            h, rows = textvec.shingles(*textvec.word_hashes(*utf8(batch.column(3))), WORDS)
            sign = signatures(h, rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(rows)), pa.array([x.tobytes() for x in sign], pa.binary())],
                names=["doc_id", "k1", "k2", "n", "signature"])

    made = _keyed(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, signature binary")
    made = made.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"),
                                        F.first("n").alias("n"), F.first("signature").alias("signature"))
    # Written at once, so the ids stay.
    return written(made.withColumn("id", F.monotonically_increasing_id()), "texts")


def _trie_rows(texts: DataFrame) -> DataFrame:
    """For each text and tree: node (hash of tree and prefix), rest (the label's other values), id,
    sketch (a byte of each of the prefixes' values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sign = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32)
                sign = sign.reshape(part.num_rows, TREES, DEPTH).astype(np.uint64)
                node = np.zeros(sign.shape[:2], np.uint64) + np.arange(TREES, dtype=np.uint64)
                for k in range(PREFIX):
                    node = textvec.mix(node * _SALT[0] + sign[:, :, k])
                rest = np.zeros_like(node)
                for k in range(PREFIX, DEPTH):
                    rest = (rest << np.uint64(32 // max(1, DEPTH - PREFIX))) + (sign[:, :, k] >> np.uint64(8))
                sketch = [x.tobytes() for x in sign[:, :, :PREFIX].astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)),
                     pa.array(np.repeat(part.column(0).to_numpy(), TREES)),
                     pa.array(np.repeat(np.array(sketch, object), TREES), pa.binary())],
                    names=["node", "rest", "id", "sketch"])

    return texts.filter("n > 0").select("id", "signature").mapInArrow(run, "node long, rest long, id long, sketch binary")


def _node_edges(ids: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Within a node: for each row the smallest id of the rows that its signature leads to."""
    n = len(ids)
    like = np.zeros((n, n), bool)
    for at in range(0, n, 64):
        like[at:at + 64] = (sketch[at:at + 64, None] == sketch[None]).mean(axis=2) >= ALIKE
    return _roots(like, ids)


def _roots(like: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric relation leads to."""
    lab = ids.copy()
    while True:
        new = lab.copy()
        for at in range(0, len(ids), 512):
            near = like[at:at + 512]
            new[at:at + 512] = np.minimum(lab[at:at + 512], np.where(near, lab, np.iinfo(np.int64).max).min(axis=1))
        if (new == lab).all():
            return lab
        lab = new


def _propose(rows: DataFrame) -> DataFrame:
    """Edges a, b between texts of a trie node; `cut` names the node of a piece's roots if the node
    may go on in another piece."""
    parts = parallelism(rows.sparkSession)
    rows = rows.repartitionByRange(parts, "node", "rest", "id").sortWithinPartitions("node", "rest", "id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Runs of rows of whole nodes or pieces of NODE_ROWS; whether the first node may have begun
        elsewhere; whether the last may go on elsewhere."""
        held, goes_on = None, True  # the first node may have begun in another partition
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (batch.column(0).to_numpy(), batch.column(2).to_numpy(),
                    np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            if held:
                part = tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            node = part[0]
            last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            while len(node) - last > NODE_ROWS:
                last += NODE_ROWS
            if last:
                before, goes_on = goes_on, bool(node[last - 1] == node[-1])
                yield tuple(x[:last] for x in part), before, goes_on
            held = tuple(x[last:] for x in part)
        if held:
            yield held, goes_on, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, ids, sketch), begun, goes_on in pieces(batches):
            new = np.ones(len(node), bool)
            new[1:] = node[1:] != node[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(node)))
            head = np.repeat(start, size)
            root = ids[head].copy()
            like = (sketch == sketch[head]).mean(axis=1) >= ALIKE
            cut = np.zeros(len(node), bool)  # rows of nodes that are cut
            apart = np.zeros(len(start), bool)
            np.logical_or.at(apart, np.repeat(np.arange(len(start)), size), ~like)
            for k in np.flatnonzero(apart | (size > NODE_ROWS)):
                for at in range(start[k], start[k] + size[k], NODE_ROWS):
                    end = min(at + NODE_ROWS, start[k] + size[k])
                    root[at:end] = _node_edges(ids[at:end], sketch[at:end])
                cut[start[k]:start[k] + size[k]] |= size[k] > NODE_ROWS
            if begun:
                cut[:size[0]] = True
            if goes_on:
                cut[start[-1]:] = True
            a, b, c = ids, root, np.where(cut, node, 0)
            take = (a != b) | cut
            yield pa.RecordBatch.from_arrays([pa.array(a[take]), pa.array(b[take]), pa.array(c[take]), pa.array(cut[take])],
                                             names=["a", "b", "node", "cut"])

    return rows.mapInArrow(run, "a long, b long, node long, cut boolean")


def _proposed_components(texts: DataFrame) -> DataFrame:
    found = written(_propose(_trie_rows(texts)), "trie-edges")
    roots = found.filter("cut").groupBy("node", F.col("b").alias("a")).agg(F.lit(1).alias("one"))
    least = roots.groupBy("node").agg(F.min("a").alias("b"))
    edges = found.filter("a <> b").select("a", "b").unionByName(roots.join(least, "node").select("a", "b"))
    return connected_components(edges)


def links_of(sets: list[np.ndarray], copies: np.ndarray, ids: np.ndarray, left: np.ndarray,
             right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact links between the rows `left` and the rows `right` (indices; the same, or disjoint):
    for each row the number of copies of the texts it is linked to, and the smallest id that the
    links lead to."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    shingle, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(column, minlength=len(shingle))
    place = np.full(n, -1)
    same = left is right
    place[left] = np.arange(len(left))
    place_right = np.full(n, -1)
    place_right[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24 shingles
    bound = max(2, n // 32)
    dense = np.full(len(shingle), -1)
    frequent = np.flatnonzero(often >= bound)
    dense[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 2048):
        width = min(2048, len(frequent) - at)
        here = (dense[column] >= at) & (dense[column] < at + width)
        matrix = np.zeros((n, width), np.float32)
        matrix[row[here], dense[column[here]] - at] = 1
        common += matrix[left] @ matrix[right].T
    rare = np.flatnonzero((often[column] > 1) & (often[column] < bound))
    if len(rare):
        rare = rare[np.argsort(column[rare], kind="stable")]
        start = np.flatnonzero(np.diff(column[rare], prepend=-1))
        count = np.diff(np.append(start, len(rare)))
        for k in range(1, int(count.max())):  # the k-th row after each row of the same shingle
            x = np.flatnonzero(np.arange(len(rare)) + k < np.repeat(start + count, count))
            for p, q in ((row[rare[x]], row[rare[x + k]]), (row[rare[x + k]], row[rare[x]])):
                ok = (place[p] >= 0) & (place_right[q] >= 0)
                np.add.at(common, (place[p[ok]], place_right[q[ok]]), 1)
    total = size[left][:, None] + size[right][None]
    linked = common * (SIMILAR.numerator + SIMILAR.denominator) >= SIMILAR.numerator * total
    links, lab = np.zeros(n, np.int64), ids.copy()
    if same:
        np.fill_diagonal(linked, False)
        links[left] = linked @ copies[right]
        lab[left] = _roots(linked, ids[left])
        return links, lab
    links[left], links[right] = linked @ copies[right], linked.T @ copies[left]
    while True:
        big = np.iinfo(np.int64).max
        new = lab.copy()
        new[left] = np.minimum(lab[left], np.where(linked, lab[right], big).min(axis=1, initial=big))
        new[right] = np.minimum(lab[right], np.where(linked.T, new[left], big).min(axis=1, initial=big))
        if (new == lab).all():
            return links, lab
        lab = new


def _verified(docs: DataFrame, texts: DataFrame, components: DataFrame) -> DataFrame:
    """Rows a, b, links, several: text a has so many links in one block pair, which lead to b;
    `several` if the component has more than one block."""
    weight = F.greatest("n", F.lit(LEAST))
    member = components.join(texts.select("id", "k1", "k2", "first_doc", "copies", "n"), "id")
    blocks = member.groupBy("root").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks"))
    member = written(member.join(blocks, "root").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n"), "members")
    wanted = F.broadcast(member) if member.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else member
    # Of equal texts one is read again; repeated rows of it are dropped where they meet.
    rows = (_keyed(docs).join(wanted, ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("first_doc")))
            .select("root", "blocks", "block", "id", "copies", "text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            h, off = textvec.distinct_by_row(*textvec.shingles(*textvec.word_hashes(*utf8(batch.column(5))), WORDS))
            made = [h[off[k]:off[k + 1]].tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())],
                                             names=["root", "blocks", "block", "id", "copies", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            where = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for at, end in zip([0, *where], [*where, batch.num_rows], strict=True):
                part = batch.slice(at, end - at)
                if held and tuple(key[at]) != held[0]:
                    out.append(group(held))
                    held = []
                held = held or [tuple(key[at])]
                held.append(part)
            if sum(len(x[0]) for x in out) > 10_000:
                yield record(out)
                out = []
        if held:
            out.append(group(held))
        if out:
            yield record(out)

    def group(held: list) -> tuple:
        (_, i, j), rest = held[0], held[1:]
        block, ids, copies, blocks = (np.concatenate([x.column(k).to_numpy() for x in rest]) for k in (3, 4, 5, 7))
        raw = [s for x in rest for s in x.column(6).to_pylist()]
        keep = np.flatnonzero(np.diff(ids, prepend=-1))  # sorted by id: repeated rows go
        block, ids, copies = block[keep], ids[keep], copies[keep]
        made = [np.frombuffer(raw[k], np.uint64) for k in keep]
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links, lab = links_of(made, copies, ids, left, right)
        return ids, lab, links, np.full(len(ids), blocks[0] > 1)

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                          names=["a", "b", "links", "several"])

    kind = "root long, blocks int, block int, id long, copies long, shingles binary"
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (rows.mapInArrow(sets, kind).withColumn("other", other)
             .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "id", "copies", "shingles", "blocks"))
    dealt = dealt.repartition(parallelism(docs.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "id")
    return written(dealt.mapInArrow(verify, "a long, b long, links long, several boolean"), "verified")


def text_classes(docs: DataFrame) -> DataFrame:
    """For each different text of `docs`: k1, k2 (hashes of it), first_doc, copies, links (copies of
    the other texts it is linked to), root (the same for texts of a class)."""
    texts = _texts(docs)
    found = _verified(docs, texts, _proposed_components(texts))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    root = found.filter("not several").select(F.col("a").alias("id"), F.col("b").alias("root"))
    several = found.filter("several and a <> b").select("a", "b")
    if not several.isEmpty():
        root = root.unionByName(connected_components(several))
    return (texts.select("id", "k1", "k2", "first_doc", "copies").join(links, "id", "left").join(root, "id", "left")
            .select("k1", "k2", "first_doc", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                    F.coalesce("root", "id").alias("root")))


def document_classes(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, class_id, n_links (other documents that it is
    linked to, equal texts among them), class_size (documents of its class)."""
    classes = written(text_classes(docs), "classes")
    whole = classes.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.sum("copies").alias("class_size"))
    return (_keyed(docs).select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).join(whole, "root")
            .select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stays for each class: that of the
    smallest doc_id."""
    k1, k2, doc = (fresh(docs, c) for c in ("_k1", "_k2", "_first"))
    first = (text_classes(docs).groupBy("root")
             .agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "k1", "k2")).alias("m"))
             .select(F.col("m.k1").alias(k1), F.col("m.k2").alias(k2), F.col("m.first_doc").alias(doc)))
    text = text_or_empty()
    marked = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text)})
    return (marked.join(first, [k1, k2]).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(doc)))
            .dropDuplicates([k1, k2]).select(*docs.columns))
