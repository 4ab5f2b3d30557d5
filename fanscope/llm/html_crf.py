"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the DOM.

Each block is main text or not. Features are the tags above it, names in their classes, ids and
roles, and the shape of its text; neighbours' labels are tied by transition weights. The field is
trained by maximum likelihood (forward-backward) and decoded by Viterbi.

It is trained on labelled pages: those of `page_layouts` and a bounded sample of the given pages
(`SAMPLE` by a hash of the page), which label themselves where they use an article or main element.
Copies of both in which these elements are plain ones make the field use text and order as well.
Long pages are trained on in windows of `CHAIN` blocks, of which the first and last alone have the
weights of a page's ends; all their blocks are used.

Scale: the sample's pages come to the driver (300 of them); pages are then decoded one by one in
one pass, without a shuffle.

Defined cases: a null or empty page, or one without main text, gives an empty text; markup that is
cut off or not closed is read as browsers do, roughly; a page of one block is a chain of one;
repeated rows are extracted alike; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm.common import steps, text_or_empty
from fanscope.llm.dom_blocks import Block, blocks
from fanscope.llm.page_layouts import labelled_layouts

BITS, SAMPLE, CHAIN = 13, 300, 200
ROUNDS, RIDGE, RATE = 250, 1e-4, 0.1
_MAIN = ("article", "main")
_ASIDE = frozenset("nav aside footer header form button select label menu dialog".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PLAIN = {"article": "div", "main": "div", "section": "div", "nav": "div", "footer": "div", "aside": "div", "header": "div"}

_of_name: dict[str, int] = {}


def _feature(name: str) -> int:
    if (k := _of_name.get(name)) is None:
        if len(_of_name) > 200_000:
            _of_name.clear()
        k = _of_name[name] = zlib.crc32(name.encode()) & ((1 << BITS) - 1)
    return k


def features(chain: list[Block]) -> list[list[int]]:
    """Numbers of the features of each block."""
    out, seen = [], {}
    for k, b in enumerate(chain):
        if (of := seen.get(b.above)) is None:
            names = ["none"] + [f"in {t}" for t in {t for t, _ in b.above} - {"html", "body"}]
            names += [f"named {n}" for n in {n for _, ns in b.above for n in ns}]
            if b.above:
                names.append(f"tag {b.above[-1][0]}")
                names.append(f"under {' '.join(t for t, _ in b.above[-2:])}")
            of = seen[b.above] = [_feature(n) for n in names]
        words = b.text.count(" ") + 1
        shape = [f"words {min(words.bit_length(), 9)}", f"link {int(4 * b.link)}"]
        if b.text[-1] in ".!?":
            shape.append(f"sentence {min(words.bit_length(), 6)}")
        if "©" in b.text[:12]:
            shape.append("copyright")
        if k == 0 or k == len(chain) - 1:
            shape.append("first" if k == 0 else "last")
        out.append(of + [_feature(n) for n in shape])
    return out


class Field:
    """weights of the features for main text; trans[a, b]: from label a to b; ends: first and last main."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, ends: np.ndarray):
        self.weights, self.trans, self.ends = weights.tolist(), trans.tolist(), ends.tolist()

    def decode(self, chain: list[Block]) -> list[bool]:
        """The likeliest labels (Viterbi; of equal ones, not main)."""
        if not chain:
            return []
        w, t = self.weights, self.trans
        score, back = [0.0, self.ends[0]], []
        for k, of in enumerate(features(chain)):
            if k:
                step = [0 if score[0] + t[0][y] >= score[1] + t[1][y] else 1 for y in (0, 1)]
                score = [score[step[y]] + t[step[y]][y] for y in (0, 1)]
                back.append(step)
            score[1] += sum(w[i] for i in of)
        y = int(score[1] + self.ends[1] > score[0])
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return [bool(y) for y in reversed(out)]

    def text(self, page: str) -> str:
        chain = blocks(page)
        return "\n".join(b.text for b, y in zip(chain, self.decode(chain), strict=True) if y)


def self_labels(chain: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself; None if it doesn't."""
    inside = [any(t in _MAIN for t, _ in b.above) for b in chain]
    if not any(inside):
        return None
    return [int(i and not _is_aside([t for t, _ in b.above])) for i, b in zip(inside, chain, strict=True)]


def _is_aside(above: list[str]) -> bool:
    """Whether elements that hold no article are above a block. An article's own header holds its heading."""
    first = min(above.index(t) for t in _MAIN if t in above)
    heading = above[-1] in _HEADINGS
    return any(t in _ASIDE and not (t == "header" and heading and k > first) for k, t in enumerate(above))


def _plain(chain: list[Block]) -> list[Block]:
    return [Block(b.text, tuple((_PLAIN.get(t, t), n) for t, n in b.above), b.link) for b in chain]


def train(chains: list[tuple[list[Block], list[int]]]) -> Field:
    """Maximum likelihood with a ridge, by Adam, on chains of blocks and their labels (1: main)."""
    chains = [(features(of), y) for c, y in chains if c for of in (c, _plain(c))]
    # Windows of whole chains: features, labels, whether the page begins and ends here (1 or 0).
    chains = [(c[at:at + CHAIN], y[at:at + CHAIN], int(at == 0), int(at + CHAIN >= len(c)))
              for c, y in chains for at in range(0, len(c), CHAIN)]
    n, width = len(chains), max((len(c) for c, *_ in chains), default=1)
    size = np.array([len(c) for c, *_ in chains])
    begins, ends_here = np.array([[b, e] for *_, b, e in chains], float).reshape(-1, 2).T
    label, there = np.zeros((n, width), int), np.arange(width) < size[:, None]
    which, at = [], []
    for k, (c, y, *_) in enumerate(chains):
        label[k, :len(y)] = y
        for j, of in enumerate(c):
            which += of
            at += [k * width + j] * len(of)
    which, at = np.array(which, int), np.array(at, int)
    last = label[np.arange(n), size - 1]
    dims = 1 << BITS
    p = np.zeros(dims + 6)
    m, v = np.zeros_like(p), np.zeros_like(p)
    pair = there[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:, :-1][pair], label[:, 1:][pair]), 1)
    told = np.concatenate((np.bincount(which, label.ravel()[at], dims), seen.ravel(),
                           [(label[:, 0] * begins).sum(), (last * ends_here).sum()]))
    for k in range(1, ROUNDS + 1):
        w, t, ends = p[:dims], p[dims:dims + 4].reshape(2, 2), p[dims + 4:]
        e = np.zeros((n, width, 2))
        e[:, :, 1] = np.bincount(at, w[which], n * width).reshape(n, width)
        e[:, 0, 1] += ends[0] * begins
        e[np.arange(n), size - 1, 1] += ends[1] * ends_here
        fore, back = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        fore[:, 0] = e[:, 0]
        for j in range(1, width):
            fore[:, j] = e[:, j] + np.logaddexp(fore[:, j - 1, :1] + t[0], fore[:, j - 1, 1:] + t[1])
        for j in range(width - 2, -1, -1):
            on = e[:, j + 1] + back[:, j + 1]
            step = np.logaddexp(on[:, :1] + t[:, 0], on[:, 1:] + t[:, 1])
            back[:, j] = np.where(pair[:, j][:, None], step, 0)
        total = np.logaddexp(*fore[np.arange(n), size - 1].T)[:, None]
        main = np.where(there, np.exp(fore[:, :, 1] + back[:, :, 1] - total), 0)
        moves = [[np.exp(fore[:, :-1, a] + t[a, b] + e[:, 1:, b] + back[:, 1:, b] - total)[pair].sum() for b in (0, 1)]
                 for a in (0, 1)]
        hoped = np.concatenate((np.bincount(which, main.ravel()[at], dims), np.ravel(moves),
                                [(main[:, 0] * begins).sum(), (main[np.arange(n), size - 1] * ends_here).sum()]))
        slope = (told - hoped) / n - RIDGE * p
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        p = p + RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return Field(p[:dims], p[dims:dims + 4].reshape(2, 2), p[dims + 4:])


def fit(pages: DataFrame) -> Field:
    """The field, trained on the labelled layouts and a sample of `pages` (page_id, html)."""
    page = text_or_empty("html").alias("html")
    n = pages.count()
    bound = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))
    chosen = (pages.select(page, F.xxhash64(F.lit(5), F.col("page_id"), F.col("html")).alias("h"))
              .filter(F.pmod("h", F.lit(1 << 40)) < bound).orderBy("h", "html").limit(2 * SAMPLE).collect())
    chains = labelled_layouts()
    for r in chosen:
        chain = blocks(r["html"])
        if label := self_labels(chain):
            chains.append((chain, label))
    return train(chains)


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """For each row of `pages` (page_id, url, html): page_id, url, text (main blocks, joined by line
    feeds), n_chars."""
    field = field or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            made = [field.text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
