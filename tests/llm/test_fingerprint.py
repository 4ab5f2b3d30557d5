from __future__ import annotations

import hashlib

import numpy as np

from helpers import ODD, TEXT, docs

from fanscope.llm import fingerprint as P


def test_order_insertion_and_deletion():
    a, b, c = "one two three four five six", "seven eight", "nine ten eleven"
    f = [P.encoded(P.text_vectors([t]))[0] for t in (f"{a}\n{b}\n{c}", f"{c}\n\n  {a} \n{b}", f"{a}\n{c}", f"{a}\n{b}\n{b}\n{c}")]
    assert f[0] == f[1] and len(set(f)) == 3
    assert P.delete(f[0], b) == f[2] and P.insert(f[2], b) == f[0] and P.insert(f[0], b) == f[3]
    assert P.insert(P.encoded(P.text_vectors([""]))[0], f"{a}\n{b}\n{c}") == f[0]


def test_likeness_follows_what_is_shared():
    rng = np.random.default_rng(1)
    w = [f"w{k}" for k in rng.integers(0, 10**6, 4000)]
    base = P.text_vectors([" ".join(w[:2000])])
    for kept in (0, 500, 1000, 1500, 2000):
        other = P.text_vectors([" ".join(w[:kept] + w[2000:4000 - kept])])
        assert abs(float(P.likeness(base, other)[0]) - kept / 2000) < 0.15


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        out[i] = (len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest())
    return out


def test_report_against_brute_force(spark):
    rows = [(i * 7 % 101, None if i % 13 == 0 else f"{TEXT} {i} " * (i % 5) + "äöü" * (i % 3)) for i in range(101)]
    got = P.fingerprint_report(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == expected(rows) and len(got) == 101
    by_id = {r.doc_id: r for r in got}
    for r in got:
        prints = P.encoded(P.text_vectors([dict(rows)[r.doc_id]]))[0]
        assert r.fingerprint == prints and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[100].near_next == P.likeness(P.text_vectors([dict(rows)[100]]), P.text_vectors([dict(rows)[99]]))[0]


def test_odd_rows(spark):
    got = P.fingerprint_report(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    same = {r.fingerprint for r in got if r.n_chars == len(TEXT)}
    assert len(same) == 1
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert {r.edited_sha256 for r in empty} == {hashlib.sha256(b"").hexdigest()} and all(r.near_edited == 1 for r in empty)
    assert P.fingerprint_report(docs(spark, [])).count() == 0
    one = P.fingerprint_report(docs(spark, [(5, "ab cd")])).collect()[0]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    kept = P.document_fingerprints(docs(spark, ODD))
    assert kept.columns[:-1] == docs(spark, []).columns and kept.count() == len(ODD)
