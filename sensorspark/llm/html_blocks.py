"""Pages as blocks of text with their place in a merged element tree; linear in the page's length, whatever its markup."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Fixed values of the HTML standard: elements without content, elements whose content is no markup, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends when one of the second starts.
CLOSED_BY = {
    "p": BLOCK - {"br", "body", "html", "head", "title"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: What an element's end or start never reaches beyond when it closes others.
SCOPE = frozenset(["table", "td", "th", "html", "body", "article", "main", "section", "div", "ul", "ol", "dl"])
#: Elements that the standard defines as surroundings, as parts of forms, or as not shown.
ASIDE_TAGS = frozenset("nav header footer aside form head button select menu dialog template".split())

DEPTH, WIDTH = 100, 64  # deeper elements are children of the one at DEPTH; a node's children beyond WIDTH join the last of their tag
REACH = 64  # open elements among which a start tag looks for one that it closes

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*+>", re.I) for t in RAW}


@lru_cache(4096)
def _label(tag: str, attributes: str) -> str:
    """An element's tag with its class, id and role; numbers in them count as equal."""
    names = " ".join(sorted((a or b or c).lower() for a, b, c in _ATTRIBUTE.findall(attributes))) if attributes else ""
    return re.sub(r"\d+", "0", f"{tag} {names}".strip())


def blocks(html: str) -> tuple[list[tuple[int, str]], list[tuple[int, str, bool]]]:
    """The page's blocks (node, text) in order, and its nodes (parent, label, surroundings).

    Nodes are elements that start a block, merged: neighbours of one label under one parent are one node, so lists and runs of
    paragraphs of any length give the same tree. Inline elements are no nodes. Node 0 is the root.
    """
    out: list[tuple[int, str]] = []
    nodes: list[tuple[int, str, bool]] = [(-1, "", False)]
    depth, width, last_child = [0], [0], [-1]
    last_of_tag: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, int] = {}
    held: list[str] = []

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((stack[-1][1], text))

    def close(i: int):
        for name, _ in stack[i:]:
            opened[name] -= 1
        del stack[i:]

    at, size, tags, endless = 0, len(html), _TAG, set()
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            held.append(_decoded(html[at:begin]))
        if begin >= size - 1:
            held.append(html[begin:])
            break
        at, mark = begin + 1, html[begin + 1]
        if html.startswith("!--", at):  # an open comment holds the rest of the page
            end = html.find("-->", at + 1)
            at = end + 3 if end >= 0 else size
            continue
        if not (mark.isascii() and mark.isalpha()) and mark not in "/!?":
            held.append("<")
            continue
        m = tags.match(html, at) if mark not in "!?" else None
        if not m:
            end = html.find(">", at)
            if end < 0:  # no tag ends any more
                held.append(_decoded(html[begin:]))
                break
            if mark in "!?" or not html[at + 1 : at + 2].isalpha() and mark == "/":
                at = end + 1
                continue
            tags = _PLAIN_TAG  # a quote stays open to the page's end: from here on quotes mean nothing
            m = tags.match(html, at)
            if not m:
                at = end + 1
                continue
        at, tag = m.end(), m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                if tag in BLOCK:
                    flush()
                found = None if tag in endless else _RAW_END[tag].search(html, at)
                if found:
                    at = found.end()
                else:  # an open script or style holds the rest of the page
                    endless.add(tag)
                    at = size if tag in ("script", "style") else at
            continue
        if tag not in BLOCK:
            continue
        flush()
        if tag in VOID:
            continue
        if m[1]:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        for i in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1):
            name = stack[i][0]
            if tag in CLOSED_BY.get(name, ()):
                close(i)
                break
            if name in SCOPE:
                break
        label = _label(tag, m[3]) if len(m[3]) < 1000 else _label.__wrapped__(tag, m[3])
        parent = stack[-1][1]
        if depth[parent] >= DEPTH:
            parent = nodes[parent][0]
        node = last_child[parent]
        if node >= 0 and nodes[node][1] != label and width[parent] >= WIDTH:
            node, label = last_of_tag.get((parent, tag), -1), tag
        elif node >= 0 and nodes[node][1] != label:
            node = -1
        if node < 0:
            node = len(nodes)
            nodes.append((parent, label, tag in ASIDE_TAGS or nodes[parent][2]))
            depth.append(depth[parent] + 1)
            width.append(0)
            last_child.append(-1)
            width[parent] += 1
            if label == tag:
                last_of_tag[parent, tag] = node
        last_child[parent] = node
        stack.append((tag, node))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out, nodes


def _decoded(text: str) -> str:
    return unescape(text) if "&" in text else text


def plain_text(html: str) -> str:
    """All blocks of a page, one a line."""
    return "\n".join(t for _, t in blocks(html)[0])
