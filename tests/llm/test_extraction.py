"""Extraction on pages by other hands than the layouts that the field is trained on."""

from __future__ import annotations

import random

import pytest

from fanscope.llm import html_crf as H
from fanscope.llm.dom_blocks import Block, blocks
from fanscope.llm.page_layouts import labelled_layouts


@pytest.fixture(scope="module")
def field():
    return H.train(labelled_layouts())


def sentence(rng, n):
    return " ".join(rng.choice("river stone market under letter garden window after people seven walked slowly".split()) for _ in range(n)).capitalize() + "."


SHELLS = (  # %s: the paragraphs
    '<body><ul><li><a href="/a">Start</a><li><a href="/b">Politics</a><li><a href="/c">Culture</a></ul><div class="entry">%s</div>'
    '<div class="footer">&copy; 2020 The Paper</div></body>',
    '<html><body><div><a href="/">The Paper</a> <a href="/x">Contact</a></div><div>%s</div><div>&copy; 2020 The Paper</div></body></html>',
    '<body><nav><a href="/a">Start</a> <a href="/b">Politics</a></nav><div id="story-body">%s</div><footer><p>Imprint and terms</p></footer></body>',
    '<body><header><h3>The Paper</h3><ul><li><a href="/a">Start</a></li></ul></header><section>%s</section><aside><p>Read these as well, they '
    'are much longer than a line and tell of other matters.</p></aside></body>',
)


@pytest.mark.parametrize("shell", range(len(SHELLS)))
@pytest.mark.parametrize("tag", ["p", "div"])
def test_paragraphs_of_any_length_in_pages_that_mark_no_article(field, shell, tag):
    rng, kept, made, false = random.Random(shell), 0, 0, 0
    for n in (10, 16, 20, 25, 30, 31, 45, 70):
        for _ in range(6):
            said = [sentence(rng, n) for _ in range(rng.randint(3, 8))]
            got = field.text(SHELLS[shell] % "".join(f"<{tag}>{x}</{tag}>" for x in said)).split("\n")
            kept, made, false = kept + len(set(got) & set(said)), made + len(set(said)), false + len(set(got) - set(said) - {""})
    assert kept >= 0.95 * made and false <= 0.05 * made, (kept, made, false)


def test_short_lengths_tell_nothing():
    """Both kinds of paragraphs in the layouts have the same lengths."""
    main, other = [], []
    for chain, label in labelled_layouts():
        for b, y in zip(chain, label, strict=True):
            if b.link == 0 and b.text.endswith("."):
                (main if y else other).append(b.text.count(" ") + 1)
    share = lambda of, a, b: sum(a <= n <= b for n in of) / len(of)
    for a, b in ((16, 31), (32, 63), (64, 127)):
        assert 0.6 < share(main, a, b) / share(other, a, b) < 1.7


@pytest.mark.parametrize(("page", "want"), [
    ('<div title="a > b">hello', ["hello"]),
    ("<p class='x>y' id=z>one</p><p title=\"unclosed>two</p><p>three", ["one", "two", "three"]),
    ('<p>a<p hidden>b</p><div style="color:red; DISPLAY : none"><p>c</p>d</div><p>e <span hidden>f <span>g</span></span> h</p>', ["a", "e h"]),
    ('<p data-hidden-by="x">kept</p><p>1 < 2 and a=b</p>', ["kept", "1 < 2 and a=b"]),
])
def test_blocks_of_odd_markup(page, want):
    assert [b.text for b in blocks(page)] == want


def test_comments_and_hidden_parts_are_left_out(field):
    said = [sentence(random.Random(k), 40) for k in range(4)]
    for other in ('<div id="disqus_thread"><p>%s</p></div>', '<div class="reply">%s</div>', '<div style="display:none">%s</div>', '<p hidden>%s</p>'):
        page = f"<body><article><h1>Title of it</h1><p>{said[0]}</p><p>{said[1]}</p></article>{other % said[2]}<footer>End</footer></body>"
        assert field.text(page) == "\n".join(["Title of it", *said[:2]]), other


def test_an_articles_own_header_holds_its_heading():
    chain = blocks("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By Ann</p></header><p>Text</p><footer><h2>More</h2></footer></article>")
    assert [(b.text, y) for b, y in zip(chain, H.self_labels(chain), strict=True)] == [
        ("Site", 0), ("Title", 1), ("By Ann", 0), ("Text", 1), ("More", 0)]


def test_long_pages_are_trained_on_whole(monkeypatch):
    """What stands behind the first window counts: here, that late blocks of a kind are no main text."""
    chain = [Block(f"main {k}.", (("article", ()),), 0.0) for k in range(300)] + [Block(f"late {k}.", (("article", ()), ("dl", ("odd",))), 0.0) for k in range(300)]
    field = H.train([(chain, [1] * 300 + [0] * 300)] * 3)
    assert field.decode(chain) == [True] * 300 + [False] * 300


def test_windows_sum_up_as_whole_chains_where_none_is_cut(monkeypatch):
    made = labelled_layouts(1)
    whole = H.train(made)
    monkeypatch.setattr(H, "CHAIN", 10_000)
    assert H.train(made).weights == whole.weights


def test_very_long_and_repeated_pages(spark):
    body = "".join(f"<p>{sentence(random.Random(k), 20)}</p>" for k in range(5000))
    page = f"<nav><a href=x>Menu</a></nav><article>{body}</article><footer>End</footer>"
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "v", "<article><p>x y z.</p></article>")], "page_id long, url string, html string")
    got = H.main_text(rows).collect()
    texts = [r.text for r in got if r.page_id == 1]
    assert len(texts) == 2 and texts[0] == texts[1] == "\n".join(sentence(random.Random(k), 20) for k in range(5000))
