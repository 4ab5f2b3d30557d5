"""Leaf blocks of an HTML page: runs of text that no block element interrupts, with what stands above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: A tag ends at the first > that isn't inside a quoted value.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)"""
                    r"""|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
#: An element that isn't shown.
_HIDDEN = re.compile(r"""\bhidden(?=\s|/|$)|\bhidden\s*=|style\s*=\s*["']?[^"'>]*display\s*:\s*none""", re.I)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that begin a block; those whose content is no text; those without an end.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre
    section select summary table tbody td tfoot th thead tr ul""".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe svg".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element of the key ends open elements of the value that aren't outside a container of their own.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table select menu".split())


@dataclass
class Block:
    text: str
    above: tuple  # (tag, names of class, id and role) from the outermost
    link: float  # share of its characters in links


def blocks(page: str) -> list[Block]:
    """The blocks of the whole page, in order: character references decoded, white space turned into
    single spaces. Markup that is cut off at the end of the page is no text, and neither is what is
    in hidden elements."""
    out: list[Block] = []
    stack: list[tuple] = []
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    unseen: list[str] = []  # an inline element that isn't shown, and elements of its name in it

    def close() -> None:
        nonlocal linked
        unseen.clear()
        if any(names is None for _, names in stack):
            text.clear()
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, tuple(stack), min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            part = m[0]
            if not unseen and (part[0] != "<" or part == "<"):
                text.append(part)
                if in_link:
                    linked += len(part.strip())
            continue
        tag = tag.lower()
        if tag in RAW_TAGS:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(f"</{tag}", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            if unseen and tag == unseen[0]:
                if m[1]:
                    unseen.pop()
                else:
                    unseen.append(tag)
            elif not unseen and not m[1] and tag not in VOID_TAGS and m[3] and _HIDDEN.search(m[3]):
                unseen.append(tag)
            continue
        close()
        in_link = 0
        if tag in VOID_TAGS:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph ends where another block begins
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in _HOLDS or tag not in _ENDS:
                break
            if stack[k][0] in _ENDS[tag]:
                del stack[k:]
                break
        if m[3] and _HIDDEN.search(m[3]):
            stack.append((tag, None))
            continue
        names = tuple(_WORD.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).lower())) if m[3] else ()
        stack.append((tag, names))
    close()
    return out
