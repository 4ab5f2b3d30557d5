from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, TEXT, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from fanscope.llm import id_coder as C
from fanscope.llm import token_files as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 100, C.BLOCK, C.BLOCK + 1, 3 * C.BLOCK + 17])
@pytest.mark.parametrize("high", [1, 2, 300, 1 << 32])
def test_round_trip(n, high):
    ids = np.random.default_rng(n + 1).integers(0, high, n, np.uint64).astype(np.uint32)
    assert (C.decode(C.encode(ids)) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 60))
def test_round_trip_of_any_ids(ids, block):
    whole, C.BLOCK = C.BLOCK, block
    try:
        ids = np.array(ids, np.uint32)
        assert (C.decode(C.encode(ids)) == ids).all()
    finally:
        C.BLOCK = whole


def test_contexts_pay(monkeypatch):
    monkeypatch.setattr(C, "SMALL", C.BLOCK)
    rng = np.random.default_rng(0)
    flat = rng.integers(0, 500, 40_000).astype(np.uint32)
    phrases = np.concatenate([p for p in rng.integers(0, 500, (200, 20)).astype(np.uint32)[rng.integers(0, 200, 2000)]])
    assert len(C.encode(phrases)) < 0.75 * len(C.encode(flat)) and len(C.encode(flat)) < 0.3 * 4 * len(flat)


def test_blocks_are_independent_and_checked():
    """Any block is read from the segment's prior and its own bytes; a broken one is found, and the
    others are read."""
    ids = np.random.default_rng(5).integers(0, 1000, 3 * C.BLOCK).astype(np.uint32)
    data, size = C.encode(ids), C.SMALL
    (prior, blocks), = C.segments(data)
    assert [n for n, *_ in blocks] == [size] * (len(ids) // size)
    for k in (1, len(blocks) - 1, 0):
        assert (C.decode_block(prior, blocks[k]) == ids[k * size:(k + 1) * size]).all()
    n, crc, code = blocks[1]
    for at in (0, 5, len(code) // 2, len(code) - 5):
        broken = bytearray(code)
        broken[at] ^= 0x5A
        with pytest.raises(C.BrokenBlock):
            C.decode_block(prior, (n, crc, bytes(broken)))
        whole = data.replace(code, bytes(broken))
        with pytest.raises(C.BrokenBlock):
            C.decode(whole)
        (_, others), = C.segments(whole)
        assert (C.decode_block(prior, others[2]) == ids[2 * size:3 * size]).all()
    for bad in (data[:-3], data[:20], data[:12] + b"?" + data[13:]):
        with pytest.raises(C.BrokenBlock):
            C.decode(bad)


def test_more_ids_than_one_table_holds(monkeypatch):
    monkeypatch.setattr(C, "MOST", 100)
    ids = np.random.default_rng(6).permutation(1000).astype(np.uint32)
    assert len(C.segments(C.encode(ids))) >= 10 and (C.decode(C.encode(ids)) == ids).all()


def test_real_text_takes_fewer_bits_than_its_entropy():
    """Ids of given texts, against the order-0 entropy of all of them (which a coder would need if it
    had their frequencies for nothing)."""
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).combine_chunks()
    ids, _ = T.encoder(VOCABULARY).encode(texts.slice(0, 2500))
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    assert 8 * len(C.encode(ids)) / len(ids) < 0.98 * entropy


def whole_text(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def each(encoder, texts):
    import pyarrow as pa
    ids, size = encoder.encode(pa.array(texts, pa.string()))
    assert size.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if texts else []


def test_the_encoder_gives_the_ids_of_whole_texts():
    texts = ["Hello, World!! it's IT'S don't... 'quoted' x's' a''s", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b.",
             "É́ éte ΑΣ ΟΔΟΣ. Σ!", "İstanbul İ. İ. ﬁne ＡＢＣ", "a b c\x1cd\x85e 　 ́x", "naïve-test 123,456.78 a1b2 ١٢٣",
             "中文 字。 👍🏽!!", "foo--bar__baz (x) [y]. 'S's", "Ǆ ß! ẞ!", "o'clock's, L'Été. d'", "a'.", "rock'n'roll!'", "", TEXT]
    encoder = T.Encoder(VOCABULARY)
    for _ in range(2):  # unknown, then known
        assert each(encoder, texts) == whole_text(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_the_encoder_on_any_text(text):
    assert each(T.encoder(VOCABULARY), [text, "a.", text]) == whole_text([text, "a.", text])


def test_the_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    encoder = T.Encoder(VOCABULARY)
    for texts in (["one two three four", "two. five!"], [None, "", " "], ["six", "one two"], []):
        assert each(encoder, texts) == whole_text(texts)


def test_files_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 500)
    rows = [(i * 37 % 211, None if i % 17 == 0 else f"{TEXT} {i} " * (i % 4)) for i in range(211)]
    got = sorted(map(tuple, T.written_and_read(docs(spark, rows), VOCABULARY).collect()))
    want, at = [], 0
    rows.sort()
    for (i, _), ids in zip(rows, whole_text([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    T.write_ids(docs(spark, rows), str(tmp_path / "f"), VOCABULARY)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_ids(spark, str(tmp_path / "f")).collect()}
    assert back[rows[5][0]] == [*whole_text([rows[5][1]])[0], 2]


def test_odd_rows(spark):
    got = T.written_and_read(docs(spark, ODD), VOCABULARY).collect()
    assert len(got) == len(ODD) and len({r.start for r in got}) == len(ODD)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert T.written_and_read(docs(spark, []), VOCABULARY).count() == 0
