"""Labelled pages to train the extraction on: layouts in common use, with filler text.

In a layout, $a to $e are paragraphs of main text, $h a heading of it; all other text is not main. $o
and $t are paragraphs and headings of that other text. Both kinds of paragraphs have lengths of one
distribution, as have both kinds of headings: length alone tells nothing.
"""

from __future__ import annotations

import random
import re

from fanscope.llm.dom_blocks import Block, blocks

_MARK = "\x02"
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport today</a></li></ul>'
_COMMENTS = ('<h3>$t</h3><div class="comment"><b>Ann</b> <p>$o</p></div><div class="comment"><p>$o</p></div>'
             '<div class="comment reply"><p>$o</p></div>')
_FORM = '<form action="/s"><label>Your mail</label><input name="m"><button>Subscribe now</button></form>'
_COOKIE = '<div class="cookie-notice">$o <button>Accept all</button></div>'
_RELATED = '<ul><li><a href="/1">Ten things to know about it</a></li><li><a href="/2">More from this author</a></li></ul>'
_AD = '<div class="ad">$o</div>'
_FOOT = "&copy; example.org &middot; All rights reserved."

LAYOUTS = (
    f"<html><body><nav>{_MENU}</nav>{_AD}<article><h1>$h</h1><p>$a<p>$b<br><p>$c</p></article><footer>{_FOOT}</footer></body></html>",
    f"<html><body><header><h2>The Daily</h2>{_MENU}</header><main><h1>$h</h1><p>$a</p><p>$b</p><aside><h3>$t</h3>{_RELATED}"
    f"</aside><p>$c</p></main><section class='comments'>{_COMMENTS}</section><footer><p>{_FOOT}</p></footer></body></html>",
    f"<html><body>{_COOKIE}<div id='menu'>{_MENU}</div><div id='content'><h1>$h</h1><p>$a</p>{_AD}<p>$b</p><ul><li>$c</li>"
    f"<li>$d</li></ul></div><div id='sidebar'>{_RELATED}{_FORM}</div><div id='footer'>{_FOOT}</div></body></html>",
    f"<html><body><div class='header'><a href='/'>Site name</a>{_MENU}</div><div class='post'><h2>$h</h2><div>$a</div><div>$b</div>"
    f"<blockquote>$c</blockquote></div><div class='related'>{_RELATED}</div><div id='comments'>{_COMMENTS}</div></body></html>",
    f"<html><body><nav>{_MENU}</nav><article><header><h1>$h</h1></header><p>$a</p><div class='advert'>$o"
    f"</div><p>$b</p><p>$c</p><div class='share'><a href='/f'>Share this</a></div></article>{_FORM}<footer>{_FOOT}</footer>",
    f"<html><body><table><tr><td class='nav'>{_MENU}</td><td class='main'><h1>$h</h1>$a<p>$b<p>$c</td></tr></table><p>{_FOOT}</p>",
    f"<html><body><div class='banner'>$o</div><main><article><h1>$h</h1><p>$a</p><p>$b</p>"
    f"<section class='comments'>{_COMMENTS}</section></article></main><aside class='sidebar'><h3>$t</h3>{_RELATED}</aside>"
    f"<footer><ul><li><a href='/p'>Privacy</a></li><li><a href='/t'>Terms of use</a></li></ul>{_FOOT}</footer></body></html>",
    f"<html><body><div class='notice'>$o</div><nav>{_MENU}</nav><section><h1>$h</h1>"
    f"<p>$a</p><h2>$e</h2><p>$b</p><pre>$c</pre></section><div class='newsletter'>{_FORM}</div><footer><p>{_FOOT}</p></footer>",
    "<html><body><p>$a</p><p>$b</p><p>$c</p></body></html>",
    f"<html><body><h1>$h</h1><p>$a</p><p>$b</p><hr><div class='footer'>{_FOOT}</div></body></html>",
    f"<html><body><div role='navigation'>{_MENU}</div><div role='main'><h1>$h</h1><p>$a</p><figure><figcaption>$e</figcaption></figure>"
    f"<p>$b</p></div><div class='popup modal'><p>$o</p>{_FORM}</div></body></html>",
    f"<html><body><div>{_MENU}</div><div><h1>$h</h1><div>$a</div><div>$b</div><div>$c</div></div><div>{_FOOT}</div></body></html>",
    f"<html><body><div class='page'><div class='top'>{_MENU}</div><div class='story'><p>$a</p><p>$b</p><p>$c</p><p>$d</p></div>"
    f"<div class='bottom'><p>{_FOOT}</p></div></div></body></html>",
    f"<html><body>{_MENU}<div id='text'><h2>$h</h2><p>$a</p><p>$b</p><h3>$e</h3><p>$c</p></div><div id='disqus_thread'>$o<p>$o</p></div>"
    f"<p>{_FOOT}</p></body></html>",
    "<html><body><div><a href='/'>Site name</a></div><div><div>$a</div><div>$b</div><div>$c</div><div>$d</div></div></body></html>",
    "<p>$a</p>",
    "<html><body><div>$a</div></body></html>",
    "<html><body><div><div><h1>$h</h1>$a<p>$b</p></div></div></body></html>",
    f"<html><body><nav>{_MENU}</nav><form><select><option>Choose a town</option><option>North</option></select></form>{_COOKIE}"
    f"<footer>{_FOOT}</footer></body></html>",
)

#: Names of classes and ids, and elements, that hold no main text wherever they stand.
NAMES = """ad ads advert advertisement sponsored promo banner comment comments disqus responses discussion reply replies sidebar widget rail
    notice cookie cookies consent gdpr alert menu nav navbar navigation breadcrumb breadcrumbs pagination footer copyright
    legal header masthead topbar share social tags related recommended newsletter subscribe popup modal login search""".split()
ELEMENTS = "aside nav footer form".split()


def _with_insertions(rng: random.Random) -> list[str]:
    """Articles with paragraphs of other text in the middle or at the end, told by a name or an element alone."""
    out = []
    for k, name in enumerate(NAMES + ELEMENTS):
        for at in ("class", "id"):
            tag, named = (name, "") if k >= len(NAMES) else ("div", f' {at}="{name}"')
            said = [_sentences(rng, _length(rng)) for _ in range(rng.randint(1, 3))]
            other = f"<{tag}{named}>" + rng.choice((said[0], "".join(f"<p>{x}</p>" for x in said))) + f"</{tag}>"
            shell = rng.choice(("article", "main", "div", 'div class="content"'))
            inner = rng.choice((f"<h1>$h</h1><p>$a</p>{other}<p>$b</p>", f"<h1>$h</h1><p>$a</p><p>$b</p>{other}", f"{other}<p>$a</p><p>$b</p>"))
            out.append(f"<html><body><{shell}>{inner}</{shell.split()[0]}><footer>{_FOOT}</footer></body></html>")
    return out


def _sentences(rng: random.Random, words: int) -> str:
    out = []
    while words > 0:
        n = min(words, rng.randint(4, 18))
        out.append(" ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + ".")
        words -= n
    return " ".join(out)


def _length(rng: random.Random) -> int:
    """Words of a paragraph: 2 to 256, each power of two as likely."""
    return int(2 ** rng.uniform(1, 8))


def _filling(rng: random.Random, what: str) -> str:
    return _sentences(rng, rng.randint(3, 12) if what in "het" else _length(rng))


def labelled_layouts(copies: int = 6, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Chains of blocks and their labels (1: main); each layout with several fillings."""
    rng, out = random.Random(seed), []
    for layout in (*LAYOUTS * copies, *_with_insertions(rng) * 2):
        chain = blocks(re.sub(r"\$([a-ehot])", lambda m: _MARK * (m[1] not in "ot") + _filling(rng, m[1]), layout))
        label = [int(b.text.startswith(_MARK)) for b in chain]
        out.append(([Block(b.text.lstrip(_MARK), b.above, b.link) for b in chain], label))
    return out
