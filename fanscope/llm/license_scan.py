"""License scans: patience alignment of texts with licence templates.

Words that are unique in both a stretch of text and a template are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned in the same way, after
equal words at their ends are matched. Coverage is the share of a template's words that are matched.

Stretches of a text that may hold a template are found by its words other than the commonest
function words and digits: a find has so many of them in so short a stretch, as follows from `COVERAGE`
and `DENSITY`, so this loses nothing. These words are chained in the template's order, a chain for each
copy that may stand there, and each copy is aligned by itself. A find needs `COVERAGE` of the
template and `DENSITY` of the stretch from its first to its last match, and the phrases that carry the
licence's name (`NAMED`) without a word missing or between: "GNU Lesser General Public License" is
no "GNU General Public License". Of finds that overlap, the one with the most matches stays (ties:
higher coverage, then the template that comes first).

Words are runs without white space and ASCII punctuation, in lower case.

Scale: templates are a fixed table of some kB; texts are read once, whole, and nothing is shuffled.

Defined cases: a null or empty text has no find; a licence that stands several times in a text is
found each time; repeated rows are each scanned; a table without rows gives none; other columns
are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanscope.llm.common import steps, text_or_empty
from fanscope.llm.decontam import tokens
from fanscope.llm.license_templates import NAMED, TEMPLATES

COVERAGE, DENSITY = 0.8, 0.6
#: Words beside the template's own that a window has at either end at least.
SLACK = 8
#: What a word between two words of a chain costs, in words.
GAP = 0.1
#: Words that don't tell licences apart and stand everywhere.
COMMON = "a an and any are as at be by for from in is it no not of on one or that the this to under which with you 0 1 2 3 4 5"


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the elements unique in both, as a longest increasing subsequence."""
    in_a, in_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if in_b[x] == 1 and in_a.get(x) == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a) if x in place]
    tails, ends, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matching places (in a, in b), increasing in both."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i < m and j < n and (found := _anchors(a[i:m], b[j:n])):
            for x, y in found:
                out.append((i + x, j + y))
            ends = [(-1, -1), *found, (m - i, n - j)]
            gaps += [(i + p + 1, i + r, j + q + 1, j + s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Templates:
    """Templates as words, and where their telling words stand, sorted by word."""

    def __init__(self, texts: dict[str, str], named: dict[str, tuple[str, ...]] = NAMED):
        self.names = list(texts)
        h, rows = tokens(pa.array(list(texts.values()), pa.string()))
        self.words = [h[rows[k]:rows[k + 1]] for k in range(len(texts))]
        common = set(tokens(pa.array([COMMON]))[0].tolist())
        word, of, self.need = [], [], []
        for k, own in enumerate(self.words):
            lost = len(own) - math.ceil(COVERAGE * len(own))  # words that a find may lack
            telling = [q for q, w in enumerate(own.tolist()) if w not in common]
            if len(telling) <= lost:
                telling = list(range(len(own)))
            self.need.append(max(1, len(telling) - lost))
            word += own[telling].tolist()
            of += [(k, q) for q in telling]
        #: The longest stretch that a find can have.
        self.reach = [int(len(own) / DENSITY) + 1 for own in self.words]
        self.phrases = []
        for name, own in zip(self.names, self.words, strict=True):
            h, rows = tokens(pa.array(list(named.get(name, ())), pa.string()))
            self.phrases.append([_occurrences(h[rows[k]:rows[k + 1]], own) for k in range(len(rows) - 1)])
        word, self.of = np.array(word, np.uint64), np.array(of, int).reshape(-1, 2)
        order = np.argsort(word, kind="stable")
        self.word, self.of = word[order], self.of[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.word >> np.uint64(48)] = True

    def stretches(self, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, template, places in h, places in the template) of the telling words of each stretch that
        may hold a template."""
        near = np.flatnonzero(self.seen[h >> np.uint64(48)])
        low = np.searchsorted(self.word, h[near], "left")
        n = np.searchsorted(self.word, h[near], "right") - low
        place = np.repeat(near, n)
        template, q = self.of[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)].T
        order = np.lexsort((q, place, template, np.searchsorted(rows, place, "right") - 1))
        template, place, q = template[order], place[order], q[order]
        row = np.searchsorted(rows, place, "right") - 1
        # Each place once for each template; the `need`-th place from it on must be within reach.
        own = np.ones(len(place), bool)
        own[1:] = (place[1:] != place[:-1]) | (template[1:] != template[:-1])
        first = np.flatnonzero(own)
        at, of, r = place[first], template[first], row[first]
        end = np.arange(len(first)) + np.array(self.need)[of] - 1
        fits = end < len(first)
        end = np.minimum(end, max(len(first) - 1, 0))
        reach = np.array(self.reach)[of]
        fits &= (of[end] == of) & (r[end] == r) & (at[end] - at < reach)
        group = np.cumsum(np.concatenate([[True], (of[1:] != of[:-1]) | (r[1:] != r[:-1])])) if len(first) else first
        spans: list[list[int]] = []  # group, from, to, first hit
        for i in np.flatnonzero(fits).tolist():
            low_i, high_i = int(at[i] - reach[i]), int(at[end[i]] + reach[i])
            if spans and spans[-1][0] == group[i] and low_i <= spans[-1][2]:
                spans[-1][2] = high_i
            else:
                spans.append([int(group[i]), low_i, high_i, i])
        bound = np.append(first, len(place))
        for g, low_i, high_i, i in spans:
            a, b = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
            a, b = bound[a + np.searchsorted(at[a:b], low_i)], bound[a + np.searchsorted(at[a:b], high_i, "right")]
            k, in_row = int(of[i]), int(r[i])
            text = h[max(low_i, rows[in_row]):min(high_i + 1, rows[in_row + 1])].tobytes()
            if all(phrase[0] in text for phrase in self.phrases[k]):
                yield in_row, k, place[a:b], q[a:b]

    def copies(self, k: int, place: np.ndarray, q: np.ndarray, low: int, high: int) -> Iterator[list[tuple[int, int]]]:
        """For each copy of template k that may stand in a stretch, best first, the windows of
        low..high to align: as long as the template, and as long as a find can be; none reaches into
        the next copy."""
        size = len(self.words[k])
        found = [(int(place[c[0]]), int(q[c[0]]), int(place[c[-1]]), int(q[c[-1]]))
                 for c in _chains(place, q, size) if len(c) >= self.need[k]]
        starts, ends = sorted(c[0] for c in found), sorted(c[2] + 1 for c in found)
        for a, first, b, last in found:
            before, after = bisect_right(ends, a), bisect_left(starts, b + 1)
            left = max(low, ends[before - 1] if before else low)
            right = min(high, starts[after] if after < len(starts) else high)
            behind = size - last
            wide = (int(first / DENSITY) + SLACK, int(behind / DENSITY) + SLACK)
            yield [(max(left, a - x), min(right, b + y)) for x, y in ((first, behind), wide)]

    def is_named(self, k: int, match: list[tuple[int, int]]) -> bool:
        """Whether the matches hold each phrase that carries the template's name, word by word."""
        at = {j: i for i, j in match}
        return all(any(all(at.get(s + d, -1) == at.get(s, -2) + d for d in range(size)) for s in starts)
                   for _, size, starts in self.phrases[k])

    def finds(self, h: np.ndarray, rows: np.ndarray) -> list[tuple]:
        """(row, template, start, end, matched): places count from the row's start; no two overlap."""
        found = []
        for r, k, place, q in self.stretches(h, rows):
            words, taken = self.words[k].tolist(), _Taken()
            for windows in self.copies(k, place, q, int(rows[r]), int(rows[r + 1])):
                best = (0, 0, 0)
                for low, high in windows:
                    match = patience(h[low:high].tolist(), words)
                    first, last, n = _best_stretch(match)
                    if (n > best[2]
                            and self.is_named(k, [m for m in match if first <= m[0] <= last])):
                        best = (low + first, low + last + 1, n)
                start, end, n = best
                if n and n >= COVERAGE * len(words) and taken.add(start, end):
                    found.append((r, k, start - int(rows[r]), end - int(rows[r]), n))
        found.sort(key=lambda f: (f[0], -f[4], -f[4] / len(self.words[f[1]]), f[1], f[2]))
        out: list[tuple] = []
        of_row: dict[int, _Taken] = {}
        for f in found:
            if of_row.setdefault(f[0], _Taken()).add(f[2], f[3]):
                out.append(f)
        return sorted(out, key=lambda f: (f[0], f[2]))


class _Taken:
    """Stretches that don't overlap."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, start: int, end: int) -> bool:
        """Adds a stretch if it overlaps none."""
        at = bisect_right(self.ends, start)
        if at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _chains(place: np.ndarray, q: np.ndarray, size: int) -> list[list[int]]:
    """Words (sorted by place) as chains that increase in place and q, best first; a word counts 1, one
    between two costs GAP. Each is in one chain."""
    n = len(place)
    score, before = np.ones(n), np.full(n, -1)
    # A chain of fewer than `size` words isn't worth a longer gap.
    first = np.searchsorted(place, place - int(size / GAP) - 1)
    for i in range(1, n):
        j = first[i]
        gain = np.where((q[j:i] < q[i]) & (place[j:i] < place[i]), score[j:i] - GAP * (place[i] - place[j:i] - 1), 0)
        top = len(gain) - 1 - int(np.argmax(gain[::-1])) if len(gain) else 0
        if len(gain) and gain[top] > 0:
            score[i], before[i] = 1 + gain[top], j + top
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(before[i])
        if chain:
            out.append(chain[::-1])
    return out


def _best_stretch(match: list[tuple[int, int]]) -> tuple[int, int, int]:
    """First and last place in the text, and the number of matches, of the run of matches that has the
    most of them (then the shortest) among those that are dense enough."""
    if not match:
        return 0, -1, 0
    at = np.array([i for i, _ in match])
    length, count = at[None, :] - at[:, None] + 1, np.arange(len(at))[None, :] - np.arange(len(at))[:, None] + 1
    worth = np.where((count > 0) & (count >= DENSITY * length), count * (len(at) * 8 + int(at[-1] - at[0]) + 2) - length, -1)
    a, b = np.unravel_index(int(worth.argmax()), worth.shape)
    return int(at[a]), int(at[b]), int(count[a, b])


def _occurrences(phrase: np.ndarray, words: np.ndarray) -> tuple[bytes, int, list[int]]:
    """The phrase as bytes, its length, and where it stands in a template's words."""
    size = len(phrase)
    return phrase.tobytes(), size, [k for k in range(len(words) - size + 1) if (words[k:k + size] == phrase).all()]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each licence found in a text of `docs` (doc_id, text): doc_id, license, start and end
    (in words), n_matched, coverage, density. Texts without a licence have no row."""
    table = Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], table.names[k], start, end, n, n / len(table.words[k]), n / (end - start))
                    for r, k, start, end, n in table.finds(*tokens(batch.column(1)))]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)],
                                                 names=["doc_id", "license", "start", "end", "n_matched", "coverage", "density"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, start long, end long, n_matched long, coverage double, density double")
