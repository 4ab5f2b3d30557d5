"""The operators that learn: quality, toxicity, HTML extraction."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, docs

from fanscope.llm import dom_blocks, html_crf, quality, toxicity
from fanscope.llm.page_layouts import labelled_layouts

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures not present")


# --- quality
def test_votes_recover_planted_accuracies():
    rng = np.random.default_rng(0)
    n = 20_000
    bad = rng.random(n) < 0.2
    fault = rng.integers(0, 5, n)
    votes = np.full((n, 8), 2)
    for k in range(5):
        votes[bad & (fault == k), k] = 1
        votes[rng.random(n) < 0.005, k] = 1
    votes[rng.random((n, 8)) < 0.1] = 0
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, chance, share = quality.fit_votes(patterns, counts)
    assert abs(share[0] - 0.8) < 0.03 and (chance[0, :5, 1] < 0.03).all()
    assert ((good[which.ravel()] < 0.5) == bad).mean() > 0.95


@there
def test_quality_against_labels(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.scored(frame).collect()
    right = [r.keep == label[r.doc_id] for r in got if r.doc_id in label]
    good = [r.keep for r in got if label.get(r.doc_id) == 1]
    assert len(got) == frame.count() and np.mean(right) > 0.97 and np.mean(good) > 0.98
    assert quality.without_rejected(frame).count() == sum(r.keep for r in got)


def test_quality_of_odd_rows(spark):
    frame = docs(spark, ODD)
    model = quality.fit(frame)
    got = quality.scored(frame, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    kept = quality.without_rejected(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.keep for r in got)
    assert quality.scored(docs(spark, [])).count() == 0 and quality.without_rejected(docs(spark, [])).count() == 0


# --- toxicity
def test_search_is_exact():
    rng = np.random.default_rng(2)
    n_terms, n = 40, 300

    def sparse(rows):
        dense = np.where(rng.random((rows, n_terms)) < 0.1, rng.random((rows, n_terms)), 0)
        dense /= np.maximum(np.sqrt((dense ** 2).sum(axis=1)), 1e-9)[:, None]
        row, term = np.nonzero(dense)
        return dense, row, term, dense[row, term]

    examples, row, term, weight = sparse(n)
    index = toxicity.Index(row, term, weight, rng.integers(0, 2, n), np.ones(n), list(range(n)), n_terms)
    queries, *q = sparse(60)
    best, sim = index.nearest(*q, 60)
    exact = -np.sort(-(queries @ examples.T), axis=1)[:, :toxicity.NEAREST]
    assert np.allclose(sim, exact)
    for k in range(60):
        for b, s in zip(best[k], sim[k], strict=True):
            assert (b < 0 and s == 0) or np.isclose(queries[k] @ examples[index.ids[b]], s)


def toxic_docs(n=600, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"word{k}x" for k in range(300)], ["hateful", "vileness", "scumbag"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad).upper() + rng.choice([",", "!", ""])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic, "x"))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_docs()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.scored(docs(spark, rows), table).collect()
    truth = {i: t for i, _, t, _ in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == truth[r.doc_id]
        if truth[r.doc_id]:
            assert r.evidence and all(truth[e.doc_id] == e.toxic and zlib.crc32(str(e.doc_id).encode()) % 5 for e in r.evidence)
    # Labels of held-out rows don't matter.
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    again = toxicity.scored(docs(spark, rows), spark.createDataFrame(other, table.schema)).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)


def test_toxicity_of_few_labels(spark):
    # 56 labelled rows that aren't held out: chi-squared can't pass 56.
    rows, labels = toxic_docs(70, seed=3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.scored(docs(spark, rows), table).collect()
    truth = {i: t for i, _, t, _ in labels}
    assert sum(truth[r.doc_id] for r in got if r.held_out) >= 2
    assert [r.doc_id for r in got if r.predicted != truth[r.doc_id]] == []
    assert all(r.evidence and r.evidence[0].toxic for r in got if truth[r.doc_id])


def test_toxic_words_of_a_rare_group(spark):
    # Toxic words of a second language stand in few of the toxic examples.
    rows, labels = toxic_docs(600, seed=5)
    rng, bad = random.Random(6), ["ordinaire", "saleté", "crétin"]
    for i in range(1000, 1080):
        toxic = int(i % 8 == 0)
        w = [f"mot{rng.randrange(300)}y" for _ in range(rng.randint(20, 80))]
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic, "x"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.scored(docs(spark, rows), table).collect()
    truth = {i: t for i, _, t, _ in labels}
    rare = [r for r in got if r.doc_id >= 1000 and truth[r.doc_id]]
    assert len(rare) == 10 and any(r.held_out for r in rare) and all(r.predicted for r in rare)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.99


@pytest.mark.parametrize("entries", [1, 50])
def test_search_in_parts_is_the_same(monkeypatch, entries):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((130, 30)) < 0.2, rng.random((130, 30)), 0)
    row, term = np.nonzero(dense)
    index = toxicity.Index(row, term, dense[row, term], rng.integers(0, 2, 130), np.ones(130), list(range(130)), 30)
    whole = index.nearest(row, term, dense[row, term], 130, but=index.at)
    monkeypatch.setattr(toxicity, "ENTRIES", entries)
    parts = index.nearest(row, term, dense[row, term], 130, but=index.at)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_no_term_of_the_examples_is_left_out_below_the_size_bound():
    h = np.array([1, 2, 3, 1, 2, 4, 1, 5], np.uint64)
    row = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    labels = np.array([1, 1, 0])
    terms, weight = toxicity._dependent(h, labels[row], labels)
    assert terms.tolist() == [1, 2, 3, 4, 5] and (weight > 0).all() and weight[1] > weight[2]


def test_toxicity_of_odd_rows(spark):
    rows, labels = toxic_docs(200)
    odd = [(None, 1, 1, ""), (9999, 1, 1, ""), (4, None, None, ""), (5, 0, 7, "")]
    table = spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int, text string")
    frame = docs(spark, [(1000 + k, *r[1:]) if r[0] is not None else r for k, r in enumerate(ODD)] + rows)
    got = toxicity.scored(frame, table).collect()
    assert len(got) == len(ODD) + 200 and all(0 <= r.score <= 1 for r in got)
    for none in (table.limit(0), table.filter("toxic = 0")):
        few = toxicity.scored(frame, none).collect()
        assert len(few) == len(got) and all(r.predicted == 0 for r in few)
    assert toxicity.scored(docs(spark, []), table).count() == 0


def test_terms_are_words_and_their_first_bytes():
    found = Counter(h for hs, _ in toxicity.terms(pa.array(["Hello, hello heLLish", "hell"])) for h in hs.tolist())
    # The words hello, hellish and hell; of 4 bytes hell, of 5 hello and helli, of 7 hellish.
    assert sorted(found.values()) == sorted([2, 1, 1, 4, 2, 1, 1])


# --- HTML
def test_blocks():
    page = ("<title>no</title><body><!-- <p>no --><p>a <b>b</b>\n\n c<p>d &amp; e&nbsp;f<br>g<ul><li>h<li><a href=x>i</a></ul>"
            "<script>if (1 < 2) '</p>'</script>tail <div class='x y' id=\"z\">j</div> 1 < 2<style>p{}</style>k<p unclosed")
    got = dom_blocks.blocks(page)
    assert [b.text for b in got] == ["a b c", "d & e f g", "h", "i", "tail", "j", "1 < 2k"]
    assert got[3].link == 1 and got[0].link == 0 and got[5].above[-1] == ("div", ("x", "y", "z"))
    assert dom_blocks.blocks("") == [] and [b.text for b in dom_blocks.blocks("just text")] == ["just text"]


def test_field_on_layouts_it_has_not_seen():
    field = html_crf.train(labelled_layouts())
    right = [p == bool(y) for chain, label in labelled_layouts(3, seed=99)
             for p, y in zip(field.decode(chain), label, strict=True)]
    assert np.mean(right) > 0.95 and field.text("") == ""


def test_viterbi_finds_the_best_labels():
    field = html_crf.train(labelled_layouts(1))
    chain = labelled_layouts(1, seed=3)[0][0][:9]
    emission = [sum(field.weights[i] for i in of) for of in html_crf.features(chain)]
    best = max(range(1 << len(chain)), key=lambda code: sum(
        (emission[k] if code >> k & 1 else 0) + (field.trans[code >> (k - 1) & 1][code >> k & 1] if k else 0)
        for k in range(len(chain))) + field.ends[0] * (code & 1) + field.ends[1] * (code >> (len(chain) - 1) & 1))
    assert field.decode(chain) == [bool(best >> k & 1) for k in range(len(chain))]


@there
def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(120).selectExpr("*", "'x' AS text", "1 AS n_chars")
    odd = spark.createDataFrame([(None, None, None, "x", 1), (7, "u", "", "x", 1), (8, None, "<nav>a</nav>", "x", 1)], pages.schema)
    got = html_crf.main_text(pages.unionByName(odd)).collect()
    assert len(got) == 123 and all(r.n_chars == len(r.text) for r in got)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        if r.page_id in html and r.url not in (None, "u"):
            assert r.text and "©" not in r.text and all(line.strip() == line and line for line in r.text.split("\n"))
    assert sorted(r.text for r in got)[:3] == ["", "", ""]
    assert html_crf.main_text(pages.limit(0)).count() == 0
