"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of `BLOCK`, each coded on its own: it starts from a reset model and carries a
checksum, so any block can be read, or found broken, without the others. Three predictions are
mixed: an order-2 table guesses the id from the two before it, an order-1 table from the one before,
and the order-0 prediction is a table of frequencies, the prior that all blocks of a segment start from
and that is sent once. The order-0 table is fixed; the guesses, and how likely either is right given
how sure both are, are learned as the block goes on, `STRIDE` ids at a time; the latter are the mixing
weights. The mixture drives a range coder with 64-bit state and 32-bit output.

The steps of a block depend on each other, but blocks don't: NumPy codes up to `LANES` blocks side
by side, one id of each in a step. Within a stride the model stands still, so that the encoder finds
its predictions for a whole stride at once.

Format, little endian. A segment: three 32-bit numbers (blocks; bytes of the table; its crc32), the
table (zlib: gaps between the distinct ids, then their frequencies less 1, 32 bits each; frequencies add up
to 2**FREQ_BITS), then its blocks: three 32-bit numbers (ids; crc32 of the ids as 32-bit numbers; 32-bit
words of code), the code.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np

BLOCK, LANES, STRIDE = 1 << 13, 1024, 32
#: Ids of a block at least, and blocks that there should be, while ids are few.
SMALL, WIDE = 1 << 10, 512
FREQ_BITS, MIX_BITS = 17, 12
#: Distinct ids of a segment at most, and numbers of ids that can be guessed (the most frequent ones).
MOST, GUESSED = 1 << 16, 1 << 14
#: Slots of the order-1 and order-2 tables (powers of 2), and how sure a slot gets.
SLOTS_1, SLOTS_2, SURE = 1 << 11, 1 << 12, 3
#: The outcomes of a stride move a mixing weight by 2**-RATE each of what is missing.
RATE = 6
_SEGMENT, _HEAD = struct.Struct("<III"), struct.Struct("<III")
_STATES = (SURE + 1) ** 2
_NO_GUESS, _SURE, _1, _2 = (np.uint16(x) for x in ((1 << 16) - 1, SURE, 1, 2))
#: Factors of the slots' hashes, and by order the bits that a slot's number doesn't take.
_HASH, _15 = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0x2C1B3C6D)], np.uint32(15)
_SLOT_BITS = np.array([[33 - SLOTS_1.bit_length()], [33 - SLOTS_2.bit_length()]], np.uint32)
#: A range at or below this is renewed by a word; one id takes 29 bits at most, so one word always does.
_LOW, _32, _ALL = np.uint64((1 << 32) - 1), np.uint64(32), np.uint64((1 << 64) - 1)


class BrokenBlock(ValueError):
    """A block whose checksum or layout is wrong."""


class Prior:
    """Distinct ids and their frequencies (sum 2**FREQ_BITS, none 0). Symbols count from 1, the most
    frequent first; freq and before (the sum of the frequencies before) go by symbol."""

    def __init__(self, distinct: np.ndarray, freq: np.ndarray):
        self.distinct, self.sent = distinct, freq
        order = np.argsort(-freq, kind="stable")
        self.ids = np.concatenate([[0], distinct[order]]).astype(np.uint32)
        self.freq = np.concatenate([[0], freq[order]])
        self.before = np.cumsum(self.freq) - self.freq
        self.number = np.empty(len(freq), np.int64)
        self.number[order] = np.arange(1, len(freq) + 1)

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior | None:
        """Of the ids that it is to code; None if they are too many different ones."""
        if len(ids) and int(ids.max()) < 1 << 20:
            count = np.bincount(ids)
            distinct = np.flatnonzero(count)
            count = count[distinct]
        else:
            distinct, count = np.unique(ids, return_counts=True)
        if len(distinct) > MOST:
            return None
        freq = np.maximum(1, (count.astype(np.int64) << FREQ_BITS) // len(ids))
        over = int(freq.sum()) - (1 << FREQ_BITS)
        order = np.argsort(-freq, kind="stable")
        while over > 0:  # take from the most frequent
            spare = freq[order] - 1
            take = np.minimum(spare, np.maximum(1, over * freq[order] // max(int(freq.sum()), 1)))
            take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
            freq[order] -= take
            over -= int(take.sum())
        freq[order[0]] -= over
        return cls(distinct.astype(np.int64), freq)

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        if len(self.distinct) and self.distinct[-1] < 1 << 20:
            return self.by_id.take(ids)
        return self.number[np.searchsorted(self.distinct, ids)].astype(np.uint32)

    @cached_property
    def by_id(self) -> np.ndarray:
        """The symbol of each id up to the largest."""
        table = np.zeros(int(self.distinct[-1]) + 1, np.uint32)
        table[self.distinct] = self.number
        return table

    def lookup(self) -> np.ndarray:
        """The symbol of each of the 2**FREQ_BITS units."""
        return np.repeat(np.arange(len(self.freq), dtype=np.int64), self.freq)

    def pack(self) -> bytes:
        gaps = np.diff(self.distinct, prepend=0)
        return zlib.compress(gaps.astype("<u4").tobytes() + (self.sent - 1).astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        try:
            raw = zlib.decompress(data)
        except zlib.error as e:
            raise BrokenBlock(str(e)) from e
        gaps, freq = np.split(np.frombuffer(raw[:len(raw) // 8 * 8], "<u4").astype(np.int64), 2)
        freq = freq + 1
        if not len(freq) or len(raw) != 8 * len(freq) or freq.sum() != 1 << FREQ_BITS:
            raise BrokenBlock("wrong table")
        return cls(np.cumsum(gaps), freq)


class _Mixer:
    """The adaptive part of the model, for blocks side by side. A slot holds a guess (a symbol) and, in
    its two lowest bits, how sure it is (0: empty). Orders 1 and 2 are handled at once, as rows 0 and 1."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.base = np.stack([lane * SLOTS_1, lanes * SLOTS_1 + lane * SLOTS_2])
        self.slots = np.zeros(lanes * (SLOTS_1 + SLOTS_2), np.uint16)
        self.first_state = lane * _STATES
        start = np.array([0, 400, 1200, 2400])
        # Shares of 2**12, by how sure the guesses of order 2 and 1 are: how often either is right.
        self.share_2 = np.tile(np.repeat(start, SURE + 1), lanes).astype(np.int64)
        self.share_1 = np.tile(np.tile(start // 2, SURE + 1), lanes).astype(np.int64)
        self._mix()

    def _mix(self) -> None:
        """By state: units of 2**(MIX_BITS + FREQ_BITS) that order 2 gets, that both orders get, and what
        share of 2**MIX_BITS is left for order 0."""
        both = self.share_2 + (((1 << MIX_BITS) - self.share_2) * self.share_1 >> MIX_BITS)
        self.two, self.both, self.rest = self.share_2 << FREQ_BITS, both << FREQ_BITS, (1 << MIX_BITS) - both

    def places(self, last: np.ndarray, before: np.ndarray, at: np.ndarray) -> None:
        """Into `at` (..., orders, lanes): the slots after these symbols (32 bits; lanes last)."""
        h = np.empty(at.shape, np.uint32)
        one, two = h[..., 0, :], h[..., 1, :]
        np.multiply(last, _HASH[0], out=one)
        np.multiply(before, _HASH[1], out=two)
        two += one
        two ^= two >> _15
        two *= _HASH[2]
        h >>= _SLOT_BITS
        np.add(self.base[:, :at.shape[-1]], h, out=at)

    def predict(self, at: np.ndarray, slot: np.ndarray, state: np.ndarray) -> None:
        """Into the last two: what the slots hold, and the state (..., lanes)."""
        self.slots.take(at, mode="clip", out=slot)
        sure = slot & _SURE
        two = sure[..., 1, :]
        two <<= _2
        two |= sure[..., 0, :]
        np.add(self.first_state[:at.shape[-1]], two, out=state)

    def update(self, at: np.ndarray, slot: np.ndarray, state: np.ndarray, x: np.ndarray) -> None:
        """Learn the symbols x of a stride (ids, lanes). Of several outcomes at one slot the last stays."""
        guess = _guesses(x)
        new = np.where(guess == _NO_GUESS, np.uint16(0), (guess << _2) | _1)
        hit, sure = (slot >> _2) == guess[:, None], slot & _SURE
        size = len(self.share_2)
        # How often each state was there, by which of the guesses were right.
        kind = state + hit[:, 0] * size
        kind += hit[:, 1] * (2 * size)
        neither, first, second, both = np.bincount(kind.ravel(), minlength=4 * size).reshape(4, size)
        often = neither + first + second + both
        for hits, share in ((first + both, self.share_1), (second + both, self.share_2)):
            share += ((hits << MIX_BITS) - hits - often * share) >> RATE
        # A right guess gets surer, a wrong one less so until another takes its place.
        after = slot - _1
        after += hit * (_1 + (sure < _SURE))
        after += ((sure <= _1) > hit) * (new[:, None] - after)
        self.slots[at] = after
        self._mix()


def _guesses(x: np.ndarray) -> np.ndarray:
    """Symbols as slots hold them; what no slot holds for those that can't be guessed."""
    guess = x.astype(np.uint16)
    guess[x >= GUESSED] = _NO_GUESS
    return guess


def _lanes_at(sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, lanes): the lanes that still have ids; sizes descend."""
    ends = np.unique(sizes)
    starts = np.concatenate(([0], ends[:-1]))
    return [(int(a), int(b), int((sizes >= b).sum())) for a, b in zip(starts, ends, strict=True)]


def _carry(out: np.ndarray, at: np.ndarray) -> None:
    """Add 1 to the words before each `at` (in different blocks)."""
    while len(at):
        at = at - 1
        new = out.take(at) + np.uint32(1)
        out[at] = new
        at = at[new == 0]


def _encode_lanes(prior: Prior, blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks (sizes descending, none empty), coded side by side."""
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    symbols = np.zeros((int(sizes[0]) + 2, lanes), np.uint32)  # two of 0 come first
    for k, b in enumerate(blocks):
        symbols[2:len(b) + 2, k] = prior.symbols(b)
    mixer = _Mixer(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)
    room = int(sizes[0]) + 16
    out, to_word = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    shift = np.uint64(FREQ_BITS + MIX_BITS)
    freq, before = prior.freq, prior.before
    for start, end, k in _lanes_at(sizes):
        low_k, span_k, to_k = low[:k], span[:k], to_word[:k]  # views
        for i in range(start, end, STRIDE):
            x = symbols[i + 2:min(i + STRIDE, end) + 2, :k]
            at, slot = (np.empty((len(x), 2, k), t) for t in (np.int64, np.uint16))
            state = np.empty(x.shape, np.int64)
            mixer.places(symbols[i + 1:i + 1 + len(x), :k], symbols[i:i + len(x), :k], at)
            mixer.predict(at, slot, state)
            rest = mixer.rest.take(state, mode="clip")
            size, first = freq.take(x, mode="clip"), before.take(x, mode="clip")
            size *= rest
            first *= rest
            first += mixer.both.take(state, mode="clip")
            # Where a guess is right it codes the id, unless it has no share.
            hit = (slot >> _2) == _guesses(x)[:, None]
            some = (hit[:, 0] | hit[:, 1]).ravel().nonzero()[0]
            of, by_2 = state.ravel().take(some), hit[:, 1].ravel().take(some)
            two = mixer.two.take(of)
            one = mixer.both.take(of) - two
            by_2 &= two > 0
            share = np.where(by_2, two, np.where(hit[:, 0].ravel().take(some), one, 0))
            by_guess = share.nonzero()[0]
            some = some.take(by_guess)
            size.ravel()[some] = share.take(by_guess)
            first.ravel()[some] = np.where(by_2, 0, two).take(by_guess)
            size, first = size.view(np.uint64), first.view(np.uint64)
            for j in range(len(x)):
                unit = span_k >> shift
                add = first[j] * unit
                low_k += add
                np.multiply(size[j], unit, out=span_k)
                over = (low_k < add).nonzero()[0]
                if len(over):
                    _carry(out, to_k.take(over))
                thin = (span_k <= _LOW).nonzero()[0]
                if len(thin):
                    part, to = low_k.take(thin), to_k.take(thin)
                    out[to] = part >> _32
                    to_k[thin] = to + 1
                    low_k[thin] = part << _32
                    span_k[thin] <<= _32
            mixer.update(at, slot, state, x)
    made = []
    for k, b in enumerate(blocks):
        # One more word is within the range, and what follows it may be zeros.
        last = (int(low[k]) >> 32) + 1
        if last >> 32:
            _carry(out, to_word[k:k + 1])
        out[to_word[k]] = last & 0xFFFFFFFF
        code = out[k * room:int(to_word[k]) + 1].astype("<u4").tobytes()
        made.append(_HEAD.pack(len(b), zlib.crc32(b.astype("<u4").tobytes()), len(code) // 4) + code)
    return made


def _decode_lanes(prior: Prior, blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Blocks (ids descending, checksum, code) to their ids."""
    lanes, sizes = len(blocks), np.array([b[0] for b in blocks])
    lookup, freq, before = prior.lookup(), prior.freq, prior.before
    size = np.array([len(c) // 4 + 8 for *_, c in blocks])
    words = np.zeros(int(size.sum()), np.uint64)
    from_word = np.cumsum(size) - size
    for k, (*_, c) in enumerate(blocks):
        words[from_word[k]:from_word[k] + len(c) // 4] = np.frombuffer(c, "<u4")
    code = (words[from_word] << _32) + words[from_word + 1]
    from_word += 2
    mixer, span = _Mixer(lanes), np.full(lanes, _ALL)
    symbols = np.zeros((int(sizes[0]) + 2, lanes), np.uint32)
    shift = np.uint64(FREQ_BITS + MIX_BITS)
    for start, end, k in _lanes_at(sizes):
        code_k, span_k, from_k = code[:k], span[:k], from_word[:k]
        ats, slots = (np.empty((STRIDE, 2, k), t) for t in (np.int64, np.uint16))
        states = np.empty((STRIDE, k), np.int64)
        for i in range(start, end, STRIDE):
            n = min(STRIDE, end - i)
            for j, (at, slot, state) in enumerate(zip(ats[:n], slots, states, strict=False), i):
                mixer.places(symbols[j + 1, :k], symbols[j, :k], at)
                mixer.predict(at, slot, state)
                both, rest = mixer.both.take(state, mode="clip"), mixer.rest.take(state, mode="clip")
                unit = span_k >> shift
                t = (code_k // unit).view(np.int64)  # below 2**29, but for what rounding leaves at the end
                t -= both
                # Quotients of numbers this small are exact before they are cut off.
                x = lookup.take((t / rest).astype(np.int64), mode="clip")
                first, part = before.take(x, mode="clip"), freq.take(x, mode="clip")
                first *= rest
                first += both
                part *= rest
                some = (t < 0).nonzero()[0]
                if len(some):  # ids that were guessed
                    two, up_to = mixer.two.take(state.take(some)), both.take(some)
                    by_2 = t.take(some) + up_to < two
                    x[some] = np.where(by_2, slot[1].take(some), slot[0].take(some)) >> _2
                    first[some] = np.where(by_2, 0, two)
                    part[some] = np.where(by_2, two, up_to - two)
                first, part = first.view(np.uint64), part.view(np.uint64)
                first *= unit
                code_k -= first
                np.multiply(part, unit, out=span_k)
                thin = (span_k <= _LOW).nonzero()[0]
                if len(thin):
                    p = from_k.take(thin)
                    code_k[thin] = (code_k.take(thin) << _32) | words.take(p, mode="clip")
                    from_k[thin] = p + 1
                    # A range of 0 comes of damage alone; the checksum will tell.
                    span_k[thin] = np.maximum(span_k.take(thin) << _32, _LOW)
                symbols[j + 2, :k] = x
            mixer.update(ats[:n], slots[:n], states[:n], symbols[i + 2:i + 2 + n, :k])
    out = []
    for k in range(lanes):
        ids = prior.ids.take(symbols[2:sizes[k] + 2, k], mode="clip")
        if zlib.crc32(ids.astype("<u4").tobytes()) != blocks[k][1]:
            raise BrokenBlock("wrong checksum")
        out.append(ids)
    return out


def encode(ids: np.ndarray) -> bytes:
    """Ids (below 2**32), as segments one after the other: one, unless there are more than `MOST`
    different ones. Few ids make smaller blocks, so that many are coded side by side."""
    if not len(ids):
        return b""
    prior = Prior.of(ids)
    if prior is None:
        half = len(ids) // 2
        return encode(ids[:half]) + encode(ids[half:])
    size = min(BLOCK, max(SMALL, -(-len(ids) // WIDE)))
    blocks = [ids[at:at + size] for at in range(0, len(ids), size)]
    table = prior.pack()
    made = [x for at in range(0, len(blocks), LANES) for x in _encode_lanes(prior, blocks[at:at + LANES])]
    return b"".join([_SEGMENT.pack(len(blocks), len(table), zlib.crc32(table)), table, *made])


def segments(data: bytes) -> list[tuple[Prior, list[tuple[int, int, bytes]]]]:
    """The prior and the blocks (ids, checksum, code) of each segment; BrokenBlock where the layout is wrong."""
    out, at = [], 0
    while at < len(data):
        if at + _SEGMENT.size > len(data):
            raise BrokenBlock("cut short")
        n, size, crc = _SEGMENT.unpack_from(data, at)
        at += _SEGMENT.size
        table = data[at:at + size]
        if zlib.crc32(table) != crc:
            raise BrokenBlock("wrong table")
        at += size
        blocks = []
        for _ in range(n):
            if at + _HEAD.size > len(data):
                raise BrokenBlock("cut short")
            ids, check, words = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            if not 0 < ids <= BLOCK or at + 4 * words > len(data):
                raise BrokenBlock("wrong layout")
            blocks.append((ids, check, data[at:at + 4 * words]))
            at += 4 * words
        out.append((Prior.unpack(table), blocks))
    return out


def decode_block(prior: Prior, block: tuple[int, int, bytes]) -> np.ndarray:
    """The ids of one block; BrokenBlock if it is damaged."""
    return _decode_lanes(prior, [block])[0]


def decode(data: bytes) -> np.ndarray:
    """The ids of all blocks; BrokenBlock if any is damaged."""
    out = []
    for prior, blocks in segments(data):
        for k in range(0, len(blocks), LANES):
            part = blocks[k:k + LANES]
            order = sorted(range(len(part)), key=lambda j: -part[j][0])
            ids = _decode_lanes(prior, [part[j] for j in order])
            for j in np.argsort(order):
                out.append(ids[j])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
