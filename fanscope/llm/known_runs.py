"""Byte runs and their token ids, remembered in NumPy arrays and looked up for whole batches at once.

A run is kept as its bytes, in words of eight, so that a lookup compares all of it; the hash only says
where to look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TURN, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)
#: By number of bytes: the bits that these take in a word.
_BITS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words and ids, for each run that may be kept, that are kept at most.
WORDS, IDS = 4, 8


class Runs:
    """Runs (none empty) of the bytes `data`, which is padded: its length is a multiple of eight, and the
    last eight bytes are in no run."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        self._words, self._first = data.view("<u8"), None

    def __len__(self) -> int:
        return len(self.start)

    def of(self, which: np.ndarray) -> Runs:
        return Runs(self.data, self.start[which], self.size[which])

    def first(self) -> np.ndarray:
        if self._first is None:
            self._first = self._word(self.start, self.size)
        return self._first

    def _word(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        place, shift = at >> 3, ((at & 7) << 3).view(np.uint64)
        found = self._words.take(place) >> shift
        found |= self._words.take(place + 1) << (np.uint64(63) - shift) << np.uint64(1)
        found &= _BITS.take(size, mode="clip")
        return found

    def rest(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words after the first of these runs (longer than eight bytes), one after the other; the place in
        its run of each, and how many each run has."""
        count = (self.size[which] - 1) >> 3
        nth = _ranges(np.ones(len(which), np.int64), count)
        return self._word(np.repeat(self.start[which], count) + 8 * nth, np.repeat(self.size[which], count) - 8 * nth), nth, count

    def hashes(self) -> np.ndarray:
        h = self.first() * _TURN
        long = np.flatnonzero(self.size > 8)
        if len(long):
            words, nth, count = self.rest(long)
            words += nth.view(np.uint64) * _SPREAD
            words ^= words >> _32
            words *= _TURN
            words ^= words >> _32
            words *= _SPREAD
            h[long] += np.add.reduceat(words, np.cumsum(count) - count)
        h += self.size.view(np.uint64)
        h ^= h >> _32
        h *= _SPREAD
        return (h >> _32).astype(np.uint32)

    def arrow(self) -> pa.Array:
        end = np.cumsum(self.size)
        taken = self.data[_ranges(self.start, self.size)]
        offsets = np.concatenate([[0], end])
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each size says, one after the other."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


class KnownRuns:
    """Runs by number, from 1 on (0: not known), and a table of numbers by hash, at most half full."""

    def __init__(self):
        self.n, self.n_words, self.n_ids = 1, 0, 0
        self.slots = np.zeros(1 << 12, np.int32)
        self.hash, self.again = np.zeros(1 << 11, np.uint32), np.zeros(1 << 11, bool)
        #: The first eight bytes, the size, where the other words are, where the ids are and how many.
        self.key, self.size = np.zeros(1 << 11, np.uint64), np.zeros(1 << 11, np.int32)
        self.words_at, self.ids_at, self.ids_size = (np.zeros(1 << 11, np.int64) for _ in range(3))
        self.words, self.ids = np.zeros(1 << 11, np.uint64), np.zeros(1 << 13, np.uint32)

    def numbers(self, runs: Runs) -> np.ndarray:
        """The number of each run."""
        out = np.zeros(len(runs), np.int64)
        key, size = runs.first(), runs.size
        at, which = runs.hashes().astype(np.int64) & (len(self.slots) - 1), None
        while len(at):
            found = self.slots.take(at).astype(np.int64)
            same = (self.key.take(found) == key) & (self.size.take(found) == size)
            alike = np.flatnonzero(same & (size > 8))
            if len(alike):
                words, _, count = runs.rest(alike if which is None else which[alike])
                equal = words == self.words.take(_ranges(self.words_at[found[alike]], count))
                same[alike] = np.logical_and.reduceat(equal, np.cumsum(count) - count)
            if which is None:
                np.copyto(out, found, where=same)
            else:
                out[which[same]] = found[same]
            left = np.flatnonzero(~same & (found > 0))
            which = left if which is None else which[left]
            at, key, size = (at[left] + 1) & (len(self.slots) - 1), key[left], size[left]
        self.again[out] = True
        return out

    def add(self, runs: Runs, ids: list[int], count: list[int]) -> np.ndarray:
        """Remember these runs (all different, none known) with their ids, one after the other, and how many
        each has; their numbers."""
        numbers = np.arange(self.n, self.n + len(runs))
        hashes, count = runs.hashes(), np.array(count, np.int64)
        more = (runs.size - 1) >> 3  # words beside the first
        self._put(runs.first(), runs.size, hashes, more, count)
        self.ids[self.n_ids - len(ids):self.n_ids] = ids
        self.words[self.n_words - int(more.sum()):self.n_words] = runs.rest(np.flatnonzero(more))[0]
        return numbers

    def _put(self, key: np.ndarray, size: np.ndarray, hashes: np.ndarray, more: np.ndarray, count: np.ndarray) -> None:
        """All but the words and ids, for which there is room after it."""
        n, to = self.n, self.n + len(key)
        words, ids = self.n_words + np.cumsum(more), self.n_ids + np.cumsum(count)
        for name in ("hash", "again", "key", "size", "words_at", "ids_at", "ids_size"):
            setattr(self, name, _longer(getattr(self, name), to))
        self.key[n:to], self.size[n:to], self.hash[n:to], self.again[n:to] = key, size, hashes, False
        self.words_at[n:to], self.ids_at[n:to], self.ids_size[n:to] = words - more, ids - count, count
        self.n, self.n_words, self.n_ids = to, self.n_words + int(more.sum()), self.n_ids + int(count.sum())
        self.words, self.ids = _longer(self.words, self.n_words), _longer(self.ids, self.n_ids)
        if 2 * to > len(self.slots):
            while 2 * to > len(self.slots):
                self.slots = np.zeros(2 * len(self.slots), np.int32)
            n = 1
        left = np.arange(n, to, dtype=np.int32)
        at = self.hash[n:to].astype(np.int64) & (len(self.slots) - 1)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]
            other = self.slots[at] != left  # taken, or by another of these
            left, at = left[other], (at[other] + 1) & (len(self.slots) - 1)

    def forget(self, most: int) -> None:
        """Where more than `most` runs are known (or words and ids as of so many), those go that no batch had
        again since the last time; all, if more than half would be left."""
        if self.n - 1 <= most and self.n_words <= WORDS * most and self.n_ids <= IDS * most:
            return
        old, keep = self.__dict__.copy(), np.flatnonzero(self.again[:self.n])
        keep = keep[keep > 0]
        more, count = (self.size[keep] - 1) >> 3, self.ids_size[keep]
        self.__init__()
        if 2 * len(keep) <= most and 2 * int(more.sum()) <= WORDS * most and 2 * int(count.sum()) <= IDS * most:
            self._put(old["key"][keep], old["size"][keep], old["hash"][keep], more, count)
            self.words[:self.n_words] = old["words"][_ranges(old["words_at"][keep], more)]
            self.ids[:self.n_ids] = old["ids"][_ranges(old["ids_at"][keep], count)]

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs, one after the other, and where those of each end."""
        size = self.ids_size.take(numbers)
        end = np.cumsum(size)
        place = np.repeat(self.ids_at.take(numbers) - (end - size), size)
        place += np.arange(len(place))
        return self.ids.take(place), end


def _longer(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    size = len(array)
    while size < n:
        size *= 2
    out = np.zeros(size, array.dtype)  # memory is taken up where it is written to
    out[:len(array)] = array
    return out
