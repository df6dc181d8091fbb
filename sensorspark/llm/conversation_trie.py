"""The prefix trie of conversations, built as a burst trie.

Conversations become sequences of turn ids (hashes of role and text), and each prefix gets the hash of its chain. All sequences start in one container
under the root. A container of more than LIMIT sequences bursts by the next turn id: its top becomes a node of the trie's head, and its sequences move
on to one container for each next turn. Counts are combined before each shuffle, and rounds burst 1, 2, 4 ... levels of the containers that are still
too large, so there are about log2 of the deepest shared prefix. The rest, shards of at most LIMIT suffixes, is sorted and swept into nodes, one
container at a time; each sends the sums of its subtree to the few head nodes above it.

Texts are hashed and counted where they are read and never shuffled. Sequences that end at a head node (large groups of copies) are only ids: they are
sorted by ranges, packed into pieces, and one task a node streams the pieces into its digest, which can't be computed in parts.

Defined results: turns are ordered by (turn, null first), ties by the SHA-256 of role and text. A null role or text is empty. Rows without a conv_id
belong to no conversation and are left out. Repeated rows are turns of their own. Ids may be negative; c % 20 has the sign of c. An empty table has no
nodes. Extra columns are ignored. A conversation is one row of 24 bytes a turn, so one conversation, however long, must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: The most sequences in a container that is swept in one go.
LIMIT = 256
#: The most head nodes (about 100 bytes each) that are broadcast.
HEADS = 500_000
#: Ids in a piece of a digest's text.
PIECE = 50_000
ROOT = b""
SPACE = r"[ \t-\r]+"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, t): each conversation's turns in order, as an array of (turn, id, words)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.size(F.filter(F.split(text, SPACE), lambda x: x != "")).cast("long")
    t = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.substring(key, 1, 16).alias("id"), words.alias("words")).alias("t"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, ids, words): every conversation with its first h turns replaced by those of the first conversation of its block, h being crc32(conv_id) % heads."""
    own = sequences(turns)
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    t = F.concat(F.slice(F.coalesce("head", F.slice("t", 1, 0)), F.lit(1), F.col("h")), F.slice("t", F.col("h") + 1, F.size("t")))
    return own.join(first, "base", "left").select("conv_id", t.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds path: for each place of ids the hash of all ids up to it."""
    for batch in batches:
        paths = []
        for ids in batch.column("ids").to_pylist():
            path, node = [], ROOT
            for i in ids:
                node = hashlib.sha256(node + i).digest()[:16]
                path.append(node)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.binary()))], names=[*batch.schema.names, "path"])


def burst(paths: DataFrame, limit: int) -> DataFrame:
    """(node, parent, depth, n, least, words): the root, and every prefix that more than limit sequences share."""
    root = paths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    head = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "n", "least", F.lit(0).cast("long").alias("words"))
    active, done, width = paths, 0, 1
    while True:
        parent = F.concat(F.array(F.lit(ROOT)), "path")
        level = F.transform(F.slice("path", done + 1, width), lambda x, i: F.struct(x.alias("node"), F.get(parent, i + done).alias("parent"), (i + done + 1).alias("depth"), F.get(F.col("words"), i + done).alias("words")))
        big = active.select("conv_id", F.explode(level).alias("x")).select("conv_id", "x.*").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"))
        big = cut(big.where(F.col("n") > limit))
        head = head.unionByName(big)
        done, width = done + width, 2 * width
        last = big.where(F.col("depth") == done).select("node")
        if last.isEmpty():
            return cut(head)
        # a prefix that is shared often enough has only such prefixes, so the last level says which sequences go on
        active = paths.where(F.size("path") > done).withColumn("node", F.get("path", F.lit(done - 1))).join(small(last, HEADS), "node", "left_semi").drop("node")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each container, whose suffixes arrive in order. The top, first of its container, carries the path to it."""
    names = [f.split()[0] for f in _NODE.split(", ")] + ["up"]
    types = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.binary())]
    out: list[tuple] = []
    rows: list[dict] = []

    def nodes(rows: list[dict]) -> Iterator[tuple]:
        d, above = rows[0]["depth"], rows[0]["least"]
        at, least, n, words, parent, ends = [], [], [], [], [], []
        stack: list[int] = []
        before: list[bytes] = []
        for r in rows:
            suffix, conv = r["suffix"], r["conv_id"]
            k, most = 0, min(len(suffix), len(before))
            while k < most and suffix[k] == before[k]:
                k += 1
            del stack[k:]
            for j in range(k, len(suffix)):
                parent.append(stack[-1] if stack else -1)
                stack.append(len(at))
                at.append(d + j + 1)
                least.append(conv)
                n.append(0)
                words.append(r["words"][j])
                ends.append([])
            for i in stack:
                n[i] += 1
                least[i] = min(least[i], conv)
            ends[stack[-1]].append(conv)
            before = suffix
        children, leaves, saved = [0] * len(at), [0] * len(at), [(a - 1) * w for a, w in zip(n, words, strict=True)]
        for i in range(len(at) - 1, -1, -1):  # parents stand before their children
            leaves[i] = leaves[i] or 1
            if parent[i] >= 0:
                children[parent[i]] += 1
                leaves[parent[i]] += leaves[i]
                saved[parent[i]] += saved[i]
        for i, p in enumerate(parent):
            sha = hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest() if ends[i] else EMPTY_SHA
            yield least[i], at[i], least[p] if p >= 0 else above, n[i], children[i], leaves[i], saved[i], sha, rows[0]["up"] if p < 0 else None

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["container"] != rows[0]["container"]:
                out += nodes(rows)
                rows = []
                if len(out) >= 10_000:
                    yield packed()
                    out = []
            rows.append(r)
    if rows:
        out += nodes(rows)
    yield packed()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined by commas, with their first id."""
    names = ["node", "least", "ids"]
    node, run = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([run[0]], pa.int64()), pa.array([",".join(map(str, run))], pa.string())], names=names)

    for batch in batches:
        for of, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if run and (of != node or len(run) == PIECE):
                yield piece()
                run = []
            node = of
            run.append(conv)
    if run:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which arrive in order."""
    node, sha = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for of, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if sha is not None and of == node:
                sha.update(b"," + ids.encode())
            else:
                if sha is not None:
                    yield done()
                node, sha = of, hashlib.sha256(ids.encode())
    if sha is not None:
        yield done()


def nodes(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie's nodes, from (conv_id, ids, words) with one row a conv_id."""
    paths = cut(conversations.mapInArrow(_chain, "conv_id long, ids array<binary>, words array<long>, path array<binary>"))
    heads = burst(paths, limit)
    deepest = heads.agg(F.max("depth")).first()[0] or 0
    mark = F.broadcast if heads.count() <= HEADS else (lambda df: df)
    known = mark(heads.select("node", "depth", F.col("least").alias("head_least")))
    # the deepest head node on each path; what comes after it is the suffix, and the next node its container
    under = paths.select("conv_id", F.explode(F.slice("path", 1, deepest)).alias("node")).join(known, "node").groupBy("conv_id").agg(F.max(F.struct("depth", "head_least")).alias("head"))
    root = heads.where("depth = 0").select("least").first()
    placed = paths.join(under, "conv_id", "left").withColumns({"depth": F.coalesce("head.depth", F.lit(0)), "least": F.coalesce("head.head_least", F.lit(root and root[0]).cast("long"))})
    placed = placed.withColumn("up", F.concat(F.array(F.lit(ROOT)), F.slice("path", F.lit(1), F.col("depth"))))
    rest = placed.where("size(path) > depth").select("conv_id", "least", "depth", "up", F.get("path", "depth").alias("container"), *[F.slice(c, F.col("depth") + 1, F.size("path")).alias(a) for c, a in (("ids", "suffix"), ("words", "words"))])
    swept = cut(rest.repartition("container").sortWithinPartitions("container", "suffix", "conv_id").mapInArrow(_sweep, _NODE + ", up array<binary>"))
    ended = placed.where("size(path) = depth").select(F.element_at("up", -1).alias("node"), "conv_id")
    pieces = ended.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, least long, ids string")
    digests = pieces.repartition("node").sortWithinPartitions("node", "least").mapInArrow(_digests, "node binary, ends_sha256 string")
    return _heads(mark(heads), paths, swept, digests).unionByName(swept.drop("up"))


def _heads(heads: DataFrame, paths: DataFrame, swept: DataFrame, digests: DataFrame) -> DataFrame:
    """The head nodes with the sums of what lies below them."""
    tops = swept.where("up IS NOT NULL")
    children = tops.select(F.element_at("up", -1).alias("node")).unionAll(heads.where("depth > 0").select(F.col("parent").alias("node"))).groupBy("node").agg(F.count("*").alias("n_children"))
    heads = heads.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # any member's path leads through the node's ancestors
    up = F.concat(F.array(F.lit(ROOT)), F.slice("path", F.lit(1), F.col("depth")))
    own = heads.join(paths.select(F.col("conv_id").alias("least"), "path"), "least").select(F.explode(F.slice(up, F.lit(1), F.col("depth") + 1)).alias("node"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
    below = own.unionAll(tops.select(F.explode("up").alias("node"), "n_leaves", "saved_tokens")).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = heads.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    out = heads.join(below, "node").join(digests, "node", "left").join(above, "parent", "left")
    return out.select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


SQL = r"""
WITH x AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, sha256(strlen(r)::varchar || ':' || r || t)) t FROM x GROUP BY conv_id),
c AS (SELECT conv_id, t, conv_id::varchar s FROM own),
h AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 8 * len(s)), lambda i: CASE WHEN i % 8 = 0 THEN ord(s[i // 8 + 1]) ELSE 0 END::bigint)),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 4 h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(t) n, unnest(range(0, len(t) + 1)) d, t FROM r),
q AS (SELECT t[1:d] k, d, conv_id, n FROM p),
n AS (SELECT k, any_value(d) d, min(conv_id) c, count(*) n, sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (n = d), '')) ends,
  CASE WHEN any_value(d) = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(k[-1].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END w FROM q GROUP BY k),
ch AS (SELECT k[1:d - 1] k, count(*) ch FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(ch, 0) ch FROM n LEFT JOIN ch USING (k)),
a AS (SELECT k[1:i] k, sum(CASE WHEN ch = 0 THEN 1 ELSE 0 END) leaves, sum((n - 1) * w) saved FROM (SELECT *, unnest(range(0, d + 1)) i FROM f) GROUP BY 1)
SELECT f.c conv_id, f.d depth, p.c parent_conv_id, f.n n_convs, f.ch n_children, CAST(a.leaves AS BIGINT) n_leaves, CAST(a.saved AS BIGINT) saved_tokens, f.ends ends_sha256
FROM f JOIN a USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
"""
