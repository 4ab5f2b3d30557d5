"""Vectorised word and shingle hashes of many texts at once (NumPy, inside Spark tasks).

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return. Hashes have 64 bits and depend on the bytes alone, so they agree between
executors and runs.
"""

from __future__ import annotations

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
INK = np.ones(256, bool)
INK[list(SPACES)] = False

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = np.uint64(0x9E3779B97F4A7C15)
_TURN_2 = np.uint64(0x3C6EF372FE94F82A)
#: Multipliers of the words of a shingle, by place.
_WORD = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def salts(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def segments(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row: starts, ends, and the offsets of each row's runs."""
    n = len(ink)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    first[inner] = ink[inner]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and the offsets of each row's words."""
    return segments(INK[data], offsets)


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[start:end] (none empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    factor = _PLACE[place & 4095]
    if int(lens.max()) > 4096:
        factor = factor + (place >> 12).astype(np.uint64) * _TURN_2
    value = _BYTE[data[place + np.repeat(starts, lens)]] * factor
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _TURN)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the offsets of each row's words."""
    starts, ends, rows = words(data, offsets)
    return segment_hash(data, starts, ends), rows


def shingles(h: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `size` words, in order and with repeats, and each row's offsets.
    A row of fewer words, but at least one, has a single shingle of all of them."""
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(int(out[-1])) + np.repeat(rows[:-1] - out[:-1], count)
    value = np.zeros(len(at), np.uint64)
    if len(at):
        whole = np.repeat(n >= size, count)
        end = np.repeat(rows[1:], count)
        for k in range(size):
            if k and not whole.all():
                take = at + k < end
                value[take] += h[at[take] + k] * _WORD[k]
            else:
                value += h[at + k] * _WORD[k]
        value = mix(value + np.repeat(np.minimum(n, size), count).astype(np.uint64) * _TURN)
    return value, out


def distinct_by_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted, and each row's offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(rows)))


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, rows: np.ndarray, empty) -> np.ndarray:
    """`ufunc` over each row's values; `empty` for rows without any."""
    out = np.full((len(rows) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        out[full] = ufunc.reduceat(values, rows[full], axis=0)
    return out
