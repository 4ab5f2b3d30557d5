from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fanscope.llm import id_coder as C
from fanscope.llm import known_runs as K
from fanscope.llm import token_files as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def runs_of(words: list[bytes]) -> K.Runs:
    data, size = b" ".join(words), np.array([len(w) for w in words], np.int64)
    padded = np.frombuffer(data + bytes(16 - len(data) % 8), np.uint8)
    return K.Runs(padded, np.cumsum(size + 1) - size - 1, size)


def learn(known: K.KnownRuns, words: list[bytes], ids: dict[bytes, list[int]]) -> None:
    new = sorted(set(words) - {w for w, n in zip(words, known.numbers(runs_of(words)), strict=True) if n})
    known.add(runs_of(new), [i for w in new for i in ids[w]], [len(ids[w]) for w in new])


def check(known: K.KnownRuns, words: list[bytes], ids: dict[bytes, list[int]]) -> None:
    numbers = known.numbers(runs_of(words))
    assert (numbers > 0).all()
    got, end = known.ids_of(numbers)
    assert [x.tolist() for x in np.split(got, end[:-1])] == [ids[w] for w in words]


WORDS = st.lists(st.one_of(st.binary(min_size=1, max_size=3), st.text("ab\0", min_size=7, max_size=26).map(str.encode)), min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS, st.booleans())
def test_runs_are_told_apart_by_all_their_bytes(first, second, alike):
    """Also where all hashes are equal."""
    own = K.Runs.hashes
    if alike:
        K.Runs.hashes = lambda self: np.full(len(self), 7, np.uint32)
    try:
        ids = {w: [k] * (k % 4) for k, w in enumerate(dict.fromkeys(first + second))}
        known = K.KnownRuns()
        for words in (first, second):
            learn(known, words, ids)
            check(known, words, ids)
        check(known, first + second, ids)
        unknown = [w + b"c" for w in first]
        assert not known.numbers(runs_of(unknown))[[w not in ids for w in unknown]].any()
    finally:
        K.Runs.hashes = own


def test_what_a_batch_had_again_stays():
    words = [b"%d of a run" % k if k % 2 else b"%d" % k for k in range(9000)]
    ids = {w: [k, k + 1] for k, w in enumerate(words)}
    known = K.KnownRuns()
    learn(known, words, ids)
    known.forget(9000)
    assert known.numbers(runs_of(words[:100])).all()
    known.forget(8999)
    assert np.flatnonzero(known.numbers(runs_of(words))).tolist() == list(range(100))
    check(known, words[:100], ids)
    learn(known, words, ids)
    check(known, words, ids)
    known.forget(8999)  # all were had again: none stays
    assert not known.numbers(runs_of(words)).any()


def test_long_runs_are_not_kept_beyond_the_room_for_their_bytes():
    known, words = K.KnownRuns(), [b"x" * 5000, b"y" * 5000]
    learn(known, words, dict.fromkeys(words, [1]))
    known.forget(400)
    assert known.numbers(runs_of(words)).all()
    known.forget(300)
    assert not known.numbers(runs_of(words)).any() and known.n_words == 0


def test_each_run_is_learned_once():
    """More runs than there was room for before: a worker that meets them again doesn't merge them again."""
    encoder, learned = T.Encoder(VOCABULARY), []
    learn_runs = encoder._learn

    def counted(runs):
        learned.extend(runs)
        return learn_runs(runs)

    encoder._learn = counted
    letters = np.array([list(b"abcdefghijklmnopqrst")], np.uint8)[0]
    n = 160_000
    codes = np.stack([letters[np.arange(n) // 20**k % 20] for k in range(5)] + [np.full(n, 32, np.uint8)], axis=1)
    texts = [x.tobytes().decode() for x in np.array_split(codes, 8)]
    first = [encoder.encode(pa.array([t]))[0] for t in texts]
    assert len(learned) == len(set(learned)) == n
    assert all((encoder.encode(pa.array([t]))[0] == ids).all() for t, ids in zip(texts, first, strict=True))
    assert len(learned) == n


def test_remembered_runs_take_little_memory():
    tracemalloc.start()
    try:
        known, n = K.KnownRuns(), 100_000
        words = [b"%010d" % k for k in range(n)]
        runs = runs_of(words)
        held = tracemalloc.get_traced_memory()[0]
        known.add(runs, [1, 2, 3] * n, [3] * n)
        assert tracemalloc.get_traced_memory()[0] - held < 120 * n
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("text", ["a" + "!" * k for k in (1, T.SIGNS, T.SIGNS + 1, 50)] + [
    "x" * 70_000 + ".", "1.5). 'tis (so)...", "?! é!? a<|b!! <|endoftext|>!", "!!!", "a\0b\0. \0."])
def test_signs_at_the_end_and_long_runs(text):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    encoder = T.Encoder(VOCABULARY)
    for texts in ([text], ["<", text, "|", text]):
        ids, size = encoder.encode(pa.array(texts))
        assert ids[:size[0]].tolist() == want or len(texts) > 1
        assert ids[len(ids) - size[-1]:].tolist() == want


def test_one_run_of_megabytes():
    text = "ab1-" * 700_000
    data = np.frombuffer(text.encode(), np.uint8)
    runs, rows = T._runs(data, np.array([0, len(data)]))
    known = K.KnownRuns()
    known.add(runs, list(range(len(runs))), [1] * len(runs))
    assert rows.tolist() == [0, 2] and known.numbers(runs).tolist() == [1, 2]


def test_carries_run_over_words_in_each_block():
    out = np.array([3, 0xFFFFFFFF, 0xFFFFFFFF, 9, 7, 0xFFFFFFFF, 1], np.uint32)
    C._carry(out, np.array([3, 6, 4]))
    assert out.tolist() == [4, 0, 0, 10, 8, 0, 1]


def test_the_files_keep_their_format():
    """The code of fixed ids, byte for byte as it was before the coder was made faster."""
    k = np.arange(60_000, dtype=np.uint64)
    ids = ((k * k * np.uint64(2654435761) >> np.uint64(7)) % (np.uint64(1) + k % np.uint64(700)) % np.uint64(41)).astype(np.uint32)
    ids[::5] = 50_000 + ids[::5]
    assert zlib.crc32(C.encode(ids)) == 2235552557
