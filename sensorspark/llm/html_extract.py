"""HTML extraction by wrapper induction: same-host pages are aligned by simple tree matching.

1. Every page is parsed once, into a table of its blocks of text and their tree. Pages of a host that have the same upper tree are a layout, and the
   page with the smallest id of a layout is its pivot. A page's candidates are the pivots of its host's COMMON most frequent layouts and its own layout's,
   if that has LEAST_PAGES pages; so every layout that can show what varies has a wrapper, and the others take the common one that fits best.
2. Every page's tree is aligned with its candidates by simple tree matching (the largest set of pairs of nodes with equal labels that
   keeps order and ancestry) and counts for the one it fits best. For each pivot node, sums say on how many pages it was met,
   on how many its text was the pivot's, and how many characters varied (text in nodes that the pivot lacks counts at their matched ancestor).
   Pages whose smallest shingle hashes in three orders are the same count once: copies and most near copies.
3. The wrapper gives each pivot node a part: constant nodes (met on at least LEAST_PAGES pages, the pivot's text on at least CONSTANT of
   them) are template; varying ones are slots. The content slot holds the varying text: the article or main elements if at least half
   of it is theirs, else the deepest node that has all of it. Within articles all text is content, constant or not (a column's title is the article's);
   within another slot, so are constant blocks that stand beside varying ones.
   Whether text varies can't tell an advert from an article, so a node whose class, id or role names surroundings is left out, but a name never
   outranks an article or main element below it, nor all of the varying text, nor (if it only ends with such a word) most of it; names that begin
   with a negation or a word of layout (no-sidebar, has-comments) name nothing.
4. Every page is aligned again; its content is the text of nodes in the content slot, less template nodes whose text is the pivot's on this
   page too, unless nothing would be left. A page without text in the slot falls back to its own article or main elements, else to all of its text.

Elements that the HTML standard defines as surroundings or as not shown (nav, header, footer, aside, form ..., script, style) are never content.

The parsed pages are written once and never shuffled: only skeletons (labels, text hashes) of pivots and rows of numbers are shuffled, combined before they are. Pivots and wrappers are
broadcast while they measure at most BROADCAST_BYTES. Beyond it, those of hosts with at least a HOT-th of all pages are (so fewer than HOT hosts), and
pages of other hosts, none of which has more, meet theirs by a shuffle.

Work is bounded on any markup: parsing is linear, trees are at most DEPTH deep and about WIDTH wide a node, and pages for which the matching would
compare more than PAIRS pairs of nodes are aligned by path (parent, label, place among equals) instead.

Defined results: a null or empty html gives an empty text; a url without a host is of the host ''. Repeated rows get a row each. A null
page_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix
from .html_blocks import blocks
from .near_dedup import shingle_sets

COMMON = 3  # layouts of a host that all of its pages are aligned with
LEAST_PAGES = 3  # on which a node is met before it can be template; layouts with fewer distinct pages have slots only
CONSTANT = 0.9
PAIRS = 100_000
BROADCAST_BYTES, HOT = 64 << 20, 1000
UPPER = 3  # levels of the tree that tell layouts apart

#: Names of surroundings, by which a varying slot is left out.
NAMED = frozenset("ad ads advert adverts advertisement advertising sponsored banner menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments replies respond notice notices cookies consent alert popup modal header masthead footer copyright complementary contentinfo".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


#: Words before a name that say something of the layout around it.
_ABOUT = frozenset("no non not without hide hidden has have with is show open wide full".split())
WHOLE, ENDING = 2, 1


@lru_cache(4096)
def named(label: str) -> int:
    """Whether one of a label's names is (WHOLE), or ends with (ENDING), a name of surroundings; 0 if none does."""
    tag, *names = label.split(" ")
    if tag in ("html", "body", "article", "main"):
        return 0
    words = [[w for w in _SPLIT.split(n) if w] for n in names]
    return max((WHOLE if len(w) == 1 else ENDING for w in words if w and w[-1] in NAMED and w[0] not in _ABOUT), default=0)


def surroundings(tree: tuple, asides: list[bool], mass: list[int]) -> list[bool]:
    """Which nodes are surroundings: standard elements, and named ones that hold neither an article nor what the mass (of text, by node) says is the slot."""
    n = len(tree)
    article, whole = [_is_article(label) and not asides[i] for i, (_, label) in enumerate(tree)], [0 if a else m for m, a in zip(mass, asides, strict=True)]
    for i in range(n - 1, 0, -1):
        article[tree[i][0]] |= article[i]
        whole[tree[i][0]] += whole[i]
    out = list(asides)
    for i, (parent, label) in enumerate(tree):
        name = named(label)
        slot = whole[i] == whole[0] > 0 or (name == ENDING and 2 * whole[i] > whole[0])
        out[i] = out[i] or bool(name and not article[i] and not slot) or (parent >= 0 and out[parent])
    return out


def _is_article(label: str) -> bool:
    return label.split(" ", 1)[0] in ("article", "main")


def _children(tree: tuple) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in tree]
    for i, (parent, _) in enumerate(tree):
        if parent >= 0:
            kids[parent].append(i)
    return kids


def _levels(tree: tuple) -> Counter:
    """Nodes by depth and label."""
    depth, out = [], Counter()
    for parent, label in tree:
        depth.append(depth[parent] + 1 if parent >= 0 else 0)
        out[depth[-1], label] += 1
    return out


def by_path(page: tuple, pivot: tuple) -> tuple[int, ...]:
    """Nodes of equal label and equal place among those of their label, under matched parents."""
    seen, at = Counter(), {}
    for j, (parent, label) in enumerate(pivot):
        at[parent, label, seen[parent, label]] = j
        seen[parent, label] += 1
    out, seen = [], Counter()
    for parent, label in page:
        above = out[parent] if parent >= 0 else -1
        out.append(at.get((above, label, seen[parent, label]), -1) if parent < 0 or above >= 0 else -1)
        seen[parent, label] += 1
    return tuple(out)


def align(page: tuple, pivot: tuple) -> tuple[int, ...]:
    """Simple tree matching of two trees ((parent, label), ...): the pivot's node for each node of the page, or -1."""
    other = _levels(pivot)
    if sum(n * other[k] for k, n in _levels(page).items()) > PAIRS:
        return by_path(page, pivot)
    a, b = _children(page), _children(pivot)
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def size(i: int, j: int) -> int:
        """Pairs in the largest matching of two subtrees whose roots match; as deep as the trees are."""
        if (i, j) not in memo:
            x, y = a[i], b[j]
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            pair = [[0] * len(y) for _ in x]
            for p, u in enumerate(x):
                for q, v in enumerate(y):
                    pair[p][q] = size(u, v) if page[u][1] == pivot[v][1] else 0
                    best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + pair[p][q])
            memo[i, j] = (best[-1][-1] + 1, [best, pair])
        return memo[i, j][0]

    size(0, 0)
    out, todo = [-1] * len(page), [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        best, pair = memo[i, j][1]
        p, q = len(a[i]), len(b[j])
        while p and q:
            if pair[p - 1][q - 1] and best[p][q] == best[p - 1][q - 1] + pair[p - 1][q - 1]:
                p, q = p - 1, q - 1
                todo.append((a[i][p], b[j][q]))
            elif best[p][q] == best[p - 1][q]:
                p -= 1
            else:
                q -= 1
    return tuple(out)


_align = lru_cache(4096)(align)


def _matched(nodes: list, pivots: list[tuple]) -> tuple[int, tuple[int, ...]]:
    """The pivot that fits best, and its node for each of the page's nodes."""
    tree = tuple((p, t) for p, t, _ in nodes)
    best = (-1.0, -1, ())
    for k, pivot in enumerate(pivots):
        to = _align(tree, pivot) if len(tree) < 500 else align(tree, pivot)
        fit = sum(x >= 0 for x in to) / (len(tree) + len(pivot))
        if fit > best[0]:
            best = (fit, k, to)
    return best[1], best[2]


def _texts(found: list[tuple[int, str]], n: int) -> list[str]:
    """A short hash of each node's own text."""
    own: list[list[str]] = [[] for _ in range(n)]
    for node, text in found:
        own[node].append(text)
    return [hashlib.blake2b("\n".join(t).encode(), digest_size=6).hexdigest() if t else "" for t in own]


def _lengths(found: list[tuple[int, str]], n: int) -> list[int]:
    out = [0] * n
    for node, text in found:
        out[node] += len(text)
    return out


def _parse(batches):
    """layout and page (its nodes and blocks) in place of html."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            layouts, pages = [], []
            for html in part.column("html").to_pylist():
                found, nodes = blocks(html)
                depth, upper = [], []
                for p, label, aside in nodes:
                    depth.append(depth[p] + 1 if p >= 0 else 0)
                    if depth[-1] <= UPPER and not aside:
                        upper.append((depth[-1], label))
                layouts.append(hashlib.blake2b(repr(upper).encode(), digest_size=8).hexdigest())
                pages.append(json.dumps([nodes, found]))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "url", "host")], pa.array(layouts, pa.string()), pa.array(pages, pa.string())], names=["page_id", "url", "host", "layout", "page"])


def _parsed(page: str) -> tuple[list, list]:
    nodes, found = json.loads(page)
    return found, nodes


def _skeletons(batches):
    """A pivot's number, tree, and each node's text hash and length, in place of its page."""
    for b in batches:
        out = []
        for number, page in zip(b.column("pivot").to_pylist(), b.column("page").to_pylist(), strict=True):
            found, nodes = _parsed(page)
            out.append(json.dumps([nodes, _texts(found, len(nodes)), _lengths(found, len(nodes)), number]))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("host", "layout", "n", "pivot")], pa.array(out, pa.string())], names=["host", "layout", "n", "pivot", "skeleton"])


@lru_cache(2000)
def _pivot(skeleton: str) -> tuple:
    nodes, texts, lengths, number = json.loads(skeleton)
    return tuple((p, t) for p, t, _ in nodes), [a for *_, a in nodes], texts, lengths, number


def _likeness(shingles: np.ndarray) -> int:
    """The smallest of a text's (sorted) shingle hashes in three orders, as one number: equal for most near copies, and hardly for pages that share a template."""
    if not len(shingles):
        return 0
    return int(mix(mix(mix(shingles[:1]) + mix(shingles).min()) + mix(~shingles).min())[0] >> np.uint64(1))


def _measure(batches):
    """host, pivot, page (a number that near copies share), seen: for each pivot node -1, or twice the characters that varied and 1 if its text was the pivot's."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            which, rows, prose = [], [], []
            for page, skeletons in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found, nodes = _parsed(page)
                k, to = _matched(nodes, [_pivot(s)[0] for s in skeletons])
                _, _, theirs, _, number = _pivot(skeletons[k])
                mine, length = _texts(found, len(nodes)), _lengths(found, len(nodes))
                seen, near = [-1] * len(theirs), list(to)
                for i, (p, _, aside) in enumerate(nodes):
                    if (j := to[i]) >= 0:
                        same = mine[i] == theirs[j]
                        seen[j] = same + (0 if same or aside else 2 * length[i])
                    else:
                        near[i] = near[p]
                        seen[near[i]] += 0 if aside else 2 * length[i]
                which.append(number)
                rows.append(seen)
                prose.append(" ".join(t for node, t in found if not nodes[node][2]))
            keys = [_likeness(s) for s in shingle_sets(pa.array(prose, pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which, pa.int32()), pa.array(keys, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["host", "pivot", "page", "seen"])


def _add(batches):
    """host, pivot, node, pages, same, varied: sums over a batch."""
    for b in batches:
        sums: dict[tuple, list[int]] = {}
        for host, pivot, seen in zip(*[c.to_pylist() for c in b.columns], strict=True):
            for j, x in enumerate(seen):
                if x >= 0:
                    s = sums.setdefault((host, pivot, j), [0, 0, 0])
                    s[0] += 1
                    s[1] += x & 1
                    s[2] += x >> 1
        keys = list(sums)
        kinds = [("host", pa.string()), ("pivot", pa.int32()), ("node", pa.int32())]
        columns = [pa.array([k[c] for k in keys], kind) for c, (_, kind) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([sums[k][c] for k in keys], pa.int64()) for c in range(3)]], names=["host", "pivot", "node", "pages", "same", "varied"])


CONTENT, TEMPLATE, OUTSIDE = 2, 1, 0


def wrapper(tree: tuple, asides: list[bool], lengths: list[int], sums: list) -> list[int]:
    """The part of each pivot node, from its tree, surroundings, text lengths and sums (node, pages, same, varied)."""
    n, kids = len(tree), _children(tree)
    pages, same, varied = [0] * n, [0] * n, [0] * n
    for node, p, s, v in sums:
        pages[node], same[node], varied[node] = p, s, v
    enough = pages[0] >= LEAST_PAGES and any(v for v, a in zip(varied, asides, strict=True) if not a)
    out = surroundings(tree, asides, varied if enough else lengths)
    constant = [pages[i] >= LEAST_PAGES and same[i] >= CONSTANT * pages[i] for i in range(n)]
    # few pages, or pages that are all alike, don't show what varies: then the pivot's own text counts
    mass = [0 if out[i] else varied[i] for i in range(n)]
    if pages[0] < LEAST_PAGES or not any(mass):
        mass = [0 if out[i] or constant[i] else lengths[i] for i in range(n)]
    whole = list(mass)
    for i in range(n - 1, 0, -1):
        whole[tree[i][0]] += whole[i]
    articles = [False] * n
    outermost = []
    for i, (parent, label) in enumerate(tree):
        above = parent >= 0 and articles[parent]
        articles[i] = above or (_is_article(label) and not out[i])
        if articles[i] and not above:
            outermost.append(i)
    if outermost and 2 * sum(whole[i] for i in outermost) >= whole[0]:
        slots = set(outermost)
    else:
        slot = 0
        while down := [k for k in kids[slot] if kids[k] and whole[k] == whole[slot] > 0]:
            slot = down[0]
        slots = {slot}
    part, inside = [OUTSIDE] * n, [False] * n
    # parents of blocks whose text varies: their constant blocks belong to the same text
    prose = {parent for i, (parent, _) in enumerate(tree) if not kids[i] and not out[i] and lengths[i] and not constant[i]}
    for i, (parent, _) in enumerate(tree):
        inside[i] = i in slots or (parent >= 0 and inside[parent])
        if inside[i] and not out[i]:
            part[i] = TEMPLATE if constant[i] and not articles[i] and not (parent in prose and not kids[i]) else CONTENT
    return part


def content(page: tuple[list, list], wrappers: list | None) -> str:
    """A parsed page's main text by its wrappers (tree, part and text hash of each node); without any, all text outside standard surroundings."""
    found, nodes = page
    shown = [(node, t) for node, t in found if not nodes[node][2]]
    if not wrappers:
        return "\n".join(t for _, t in shown)
    k, to = _matched(nodes, [w[0] for w in wrappers])
    _, parts, theirs = wrappers[k]
    mine, mark = _texts(found, len(nodes)), [OUTSIDE] * len(nodes)
    lost = surroundings(tuple((p, t) for p, t, _ in nodes), [a for *_, a in nodes], _lengths(found, len(nodes)))
    articles = [False] * len(nodes)
    for i, (p, label, _) in enumerate(nodes):
        articles[i] = _is_article(label) or (p >= 0 and articles[p])
        if to[i] >= 0:
            mark[i] = parts[to[i]]
            if mark[i] == TEMPLATE and mine[i] != theirs[to[i]]:
                mark[i] = CONTENT
        else:
            mark[i] = OUTSIDE if lost[i] else (CONTENT if mark[p] else OUTSIDE)
    held = [(node, t) for node, t in shown if mark[node]]
    if not held:
        unnamed = [(node, t) for node, t in shown if not lost[node]]
        return "\n".join(t for node, t in unnamed if articles[node]) or "\n".join(t for _, t in unnamed)
    return "\n".join([t for node, t in held if mark[node] == CONTENT] or [t for _, t in held])


@lru_cache(2000)
def _wrapper(made: str) -> tuple:
    nodes, parts, texts = json.loads(made)
    return tuple((p, t) for p, t in nodes), parts, texts


def _extract(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = [content(_parsed(page), [_wrapper(w) for w in made or []]) for page, made in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _induce(batches):
    for b in batches:
        out = []
        for skeleton, sums in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            tree, asides, texts, lengths, _ = _pivot(skeleton)
            parts = wrapper(tree, asides, lengths, [(s["node"], s["pages"], s["same"], s["varied"]) for s in sums or []])
            out.append(json.dumps([tree, parts, texts]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["host", "pivot", "wrapper"])


def _met(pages: DataFrame, known: DataFrame, keys: list[str], column: str) -> DataFrame:
    """pages with the array that known (keys, n, column; n pages) holds for their keys; no pages are shuffled unless that table is too large to broadcast."""
    measured = known.agg(F.sum(F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))).alias("bytes"), F.sum("n").alias("n")).first()
    light = known.select(*keys, column)
    if (measured.bytes or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(light), keys, "left")
    hot = F.broadcast(known.where(F.col("n") * HOT >= measured.n).select(*keys, column))
    cold = known.where(F.col("n") * HOT < measured.n).select(*keys, column)
    rest = pages.join(hot.select(*keys), keys, "left_anti")
    return pages.join(hot, keys).unionByName(rest.join(cold, keys, "left"))


def _with_candidates(parsed: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """parsed with an array of column: its host's common pivots', and its own layout's where that isn't among them. known: host, layout, n, pivot, column."""
    pages = known.groupBy("host").agg(F.sum("n").alias("n"))
    common = known.where(F.col("pivot") < COMMON).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pivot", column))).alias("all"))  # at most COMMON
    common = common.join(pages, "host").select("host", "n", F.col(f"all.{column}").alias("_common"))
    own = known.where(F.col("pivot") >= COMMON).select("host", "layout", "n", F.array(column).alias("_own"))
    met = _met(_met(parsed, common, ["host"], "_common"), own, ["host", "layout"], "_own")
    none = F.array().cast("array<string>")
    return met.withColumn(column, F.concat(F.coalesce("_common", none), F.coalesce("_own", none))).drop("_common", "_own")


def wrappers(parsed: DataFrame) -> DataFrame:
    """host, layout, n, pivot, wrapper: from page_id, host, layout, page."""
    layouts = parsed.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min_by("page", F.struct("page_id", "page")).alias("page"))
    layouts = layouts.withColumn("pivot", (F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout")) - 1).cast("int"))  # a row a layout
    pivots = layouts.where((F.col("pivot") < COMMON) | (F.col("n") >= LEAST_PAGES)).select("host", "layout", "n", "pivot", "page")
    pivots = cut(pivots.mapInArrow(_skeletons, "host string, layout string, n long, pivot int, skeleton string"))
    met = _with_candidates(parsed.select("host", "layout", "page"), pivots, "skeleton").select("host", "page", "skeleton")
    seen = met.mapInArrow(_measure, "host string, pivot int, page long, seen array<int>").groupBy("host", "pivot", "page").agg(F.min("seen").alias("seen"))
    sums = seen.select("host", "pivot", "seen").mapInArrow(_add, "host string, pivot int, node int, pages long, same long, varied long")
    sums = sums.groupBy("host", "pivot", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "varied")])
    sums = sums.groupBy("host", "pivot").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "same", "varied"))).alias("sums"))  # as many as the pivot has nodes
    made = pivots.join(sums, ["host", "pivot"], "left").select("host", "pivot", "skeleton", "sums").mapInArrow(_induce, "host string, pivot int, wrapper string")
    return made.join(pivots.select("host", "layout", "n", "pivot"), ["host", "pivot"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = dict(pages.dtypes)["page_id"]
    parsed = cut(pages.mapInArrow(_parse, f"page_id {kind}, url string, host string, layout string, page string"))
    met = _with_candidates(parsed, cut(wrappers(parsed)), "wrapper").select("page_id", "url", "page", "wrapper")
    return met.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
