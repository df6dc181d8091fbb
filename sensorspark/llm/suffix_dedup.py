"""Suffix-array dedup: removes bytes of repeated passages, exactly, by common-prefix interval trees over anchored suffixes.

A suffix array over every byte of the corpus would move many times the corpus, so suffixes are taken at anchors: in each LENGTH-byte
window the GRAM-byte run with the smallest hash (the leftmost of equals). Equal windows choose the same anchor, so
occurrences of one window meet under one run's hash. The job has five steps, each dealt out by a hash:

1. each part of the documents sends its anchors' distinct hashes, 8 bytes each;
2. hashes that occur twice anywhere go back to the parts that sent them;
3. parts send their repeated anchors with LEFT bytes before and LENGTH bytes after. Equal surroundings within a part are settled there: all but the
   first occurrence repeat it, so a passage that a third of all documents share leaves a part once;
4. for each hash the suffixes are sorted with the common prefix lengths of neighbours (an enhanced suffix array) and a stack scan
   yields the interval tree: each interval is a group of all suffixes that share a prefix. Members of a group are told apart by their left
   extensions: without left diversity the group is one maximal repeat and all but its first occurrence are
   repeats; otherwise each member looks for the longest left extension that it shares with an earlier one;
5. the parts join the intervals, count and cut.

Parts and buckets grow in number with the bytes of text, not in size. Documents' texts are shuffled once (the exchange is reused) and whole copies of an earlier document skip steps 1 to 4.

Order and defined results: occurrences are ordered by (doc_id, nulls last; then hash of the text; then byte). Null and empty texts have 0 bytes. Rows that
repeat a doc_id and a text are one document and get its result each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, powers, prefix_hashes, shuffle_partitions

LENGTH, GRAM = 100, 36
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
STEP = 1 << 20
#: Text of a part. A task holds it and at worst some 10 times as much in surroundings and their sort keys.
PART_BYTES = 32 << 20
PAD = 0xFF  # in no UTF-8 text

DOCS = "part int, doc_id long, h1 long, text string"
BY_BUCKET = "bucket int, part int, hashes binary, times binary"
NOTES = "part int, hashes binary, copy_id long, copy_h1 long"
AROUND = "bucket int, part int, settled boolean, hashes binary, docs binary, places binary, bytes binary"
SPANS = "part int, docs binary, spans binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_NO_ID = (1 << 63) - 1


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = [], []
    for lo in range(0, n - LENGTH + 1, STEP):  # windows that start in [lo, lo + STEP)
        part = data[lo : lo + STEP + LENGTH - 1]
        h, (_, down) = prefix_hashes(part), powers(len(part) + 1)
        m = len(part) - GRAM + 1
        g = mix((h[GRAM:] - h[:-GRAM]) * down[:m])
        best = (g & ~np.uint64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
        size = 1
        while size < LEFT + 1:
            more = min(size, LEFT + 1 - size)
            best = np.minimum(best[:-more], best[more:])
            size += more
        place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = place[np.append(True, place[1:] != place[:-1])]
        at.append(place + lo)
        hashes.append(g[place])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    first = np.append(True, at[1:] != at[:-1])
    return at[first], hashes[first]


def _documents(t: pa.Table, skip: set):
    """Distinct (id, h1, bytes) of a part, less those in skip."""
    seen = set()
    for b in t.to_batches(max_chunksize=1024):
        for i, h, text in zip(b.column("doc_id").to_pylist(), b.column("h1").to_pylist(), b.column("text").to_pylist(), strict=True):
            i = _NO_ID if i is None else i
            if (i, h) not in seen and (i, h) not in skip:
                seen.add((i, h))
                yield i, h, np.frombuffer((text or "").encode(), dtype=np.uint8)


def _skipped(notes: pa.Table) -> set:
    return {(i, h) for i, h in zip(notes.column("copy_id").to_pylist(), notes.column("copy_h1").to_pylist(), strict=True) if i is not None}


def _send_hashes(buckets: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        found = [anchors(d)[1] for _, _, d in _documents(docs, _skipped(notes)) if len(d) >= LENGTH]
        rows = {c: [] for c in ("bucket", "part", "hashes", "times")}
        if found:
            h, times = np.unique(np.concatenate(found), return_counts=True)
            to = (h >> np.uint64(3)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            h, times, to = h[order], np.minimum(times[order], 2).astype(np.uint8), to[order]
            start = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for a, b in zip(start, np.append(start[1:], len(to)), strict=True):
                rows["bucket"].append(int(to[a]))
                rows["part"].append(docs.column("part")[0].as_py())
                rows["hashes"].append(h[a:b].tobytes())
                rows["times"].append(times[a:b].tobytes())
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("times", pa.binary())]))

    return run


def _repeated(t: pa.Table) -> pa.Table:
    parts = t.column("part").to_numpy()
    blobs = [np.frombuffer(x, dtype=np.uint64) for x in t.column("hashes").to_pylist()]
    times = np.frombuffer(b"".join(t.column("times").to_pylist()), dtype=np.uint8)
    h, part = np.concatenate(blobs), np.repeat(parts, [len(b) for b in blobs])
    _, at = np.unique(h, return_inverse=True)
    more = np.bincount(at, weights=times)[at] > 1
    h, part = h[more], part[more]
    order = np.argsort(part, kind="stable")
    h, part = h[order], part[order]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    ends = np.append(start[1:], len(part))
    none = [None] * len(start)
    return pa.table(
        {"part": pa.array(part[start], pa.int32()), "hashes": pa.array([h[a:b].tobytes() for a, b in zip(start, ends, strict=False)], pa.binary()), "copy_id": pa.array(none, pa.int64()), "copy_h1": pa.array(none, pa.int64())}
    )


class _Anchors:
    """Columns of repeated anchors: hash, document (id, h1), place, available bytes left and right, surrounding bytes, perhaps the part of the document."""

    def __init__(self, h, docs, place, around, part=None):
        self.h, self.docs, self.place, self.around, self.part = h, docs, place, around, part
        self.left = LEFT - (around[:, :LEFT] == PAD).sum(axis=1)
        self.right = LENGTH - (around[:, LEFT:] == PAD).sum(axis=1)

    def take(self, i) -> _Anchors:
        return _Anchors(self.h[i], self.docs[i], self.place[i], self.around[i], None if self.part is None else self.part[i])

    def sort(self) -> tuple[_Anchors, np.ndarray]:
        """By hash, suffix, reversed left side and order; and where a new surrounding begins."""
        whole = np.concatenate((self.h.astype(">u8").view(np.uint8).reshape(-1, 8), self.around[:, LEFT:], self.around[:, LEFT - 1 :: -1]), axis=1)
        wide = np.zeros((len(whole), -(-whole.shape[1] // 8) * 8), dtype=np.uint8)
        wide[:, : whole.shape[1]] = whole
        keys = wide.view(">u8").astype(np.uint64)
        order = np.lexsort((self.place, self.docs[:, 1], self.docs[:, 0], *keys.T[::-1]))
        keys = keys[order]
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) if len(keys) else np.zeros(0, bool)
        return self.take(order), new


def _pack(a: _Anchors, part: int, bucket: int, settled: bool) -> tuple:
    return bucket, part, settled, a.h.tobytes(), a.docs.tobytes(), a.place.tobytes(), b"" if settled else a.around.tobytes()


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)


def _around(a: _Anchors, later: np.ndarray) -> np.ndarray:
    """The spans of anchors whose whole surroundings occurred before: (first byte, end)."""
    return np.column_stack((a.place[later] - a.left[later], a.place[later] + a.right[later]))


def _send_surroundings(buckets: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        blobs = [x for x in notes.column("hashes").to_pylist() if x]
        rows = []
        if blobs and len(docs):
            known = np.unique(np.frombuffer(b"".join(blobs), dtype=np.uint64))
            got = []
            for i, h1, d in _documents(docs, _skipped(notes)):
                at, h = anchors(d)
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                at, h = at[known[k] == h], h[known[k] == h]
                if len(at):
                    index = at[:, None] + np.arange(-LEFT, LENGTH)
                    inside = (index >= 0) & (index < len(d))
                    around = np.where(inside, d[np.clip(index, 0, len(d) - 1)], np.uint8(PAD))
                    got.append((h, np.tile(np.array([[i, h1]], dtype=np.int64), (len(at), 1)), at, around))
            if got:
                a, new = _Anchors(*[np.concatenate(c) for c in zip(*got, strict=True)]).sort()
                part = docs.column("part")[0].as_py()
                later = np.flatnonzero(~new & (a.left + a.right >= LENGTH))
                if len(later):
                    spans = _around(a, later)
                    rows.append((part % buckets, part, True, spans.tobytes(), a.docs[later].tobytes(), None, None))
                a = a.take(np.flatnonzero(new))
                to = ((a.h >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                start = np.flatnonzero(np.append(True, np.diff(to[order]) > 0))
                for x, y in zip(start, np.append(start[1:], len(order)), strict=True):
                    rows.append(_pack(a.take(order[x:y]), part, int(to[order[x]]), False))
        return _table(rows, ["bucket", "part", "settled", "hashes", "docs", "places", "bytes"], [pa.int32(), pa.int32(), pa.bool_()] + [pa.binary()] * 4)

    return run


def intervals(lcp: list[int]):
    """The interval tree of a suffix array by a stack scan; lcp[i] is the common prefix of suffixes i and i + 1, at least 0.

    Yields (first, last, length shared by all, length shared by the interval above), children before parents.
    """
    stack = [(0, 0)]  # (length, first)
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            above = max(x, stack[-1][0] if stack else -1)
            if i > first:
                yield first, i, length, above
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def _farthest_left(order: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each member: the longest left side that it shares with one earlier in order (-1 for the first)."""
    n = len(order)
    by = np.lexsort(left.T[::-1])
    diff = left[by[1:]] != left[by[:-1]]
    shared = np.where(diff.any(axis=1), diff.argmax(axis=1), left.shape[1]).tolist()
    rank, best = order[by].tolist(), [-1] * n
    for places in (range(n), range(n - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # (rank, shared with the one being visited), ranks falling to the top
        for j in places:
            low = 0 if not stack else shared[j - 1 if places.step > 0 else j]  # the top of the stack was visited last
            while stack and stack[-1][0] > rank[j]:
                low = min(low, stack[-1][1])
                stack.pop()
            if stack:
                best[j] = max(best[j], low)
            stack.append((rank[j], low if stack else 0))
    out = np.empty(n, dtype=np.int64)
    out[by] = best
    return out


def _repeats(t: pa.Table) -> pa.Table:
    rows = []
    done = t.column("settled").to_pylist()
    for i, settled in enumerate(done):
        if settled:
            rows.append((t.column("part")[i].as_py(), t.column("docs")[i].as_py(), t.column("hashes")[i].as_py()))
    todo = t.filter(pa.array([not x for x in done]))
    if len(todo):

        def join(c, kind, *shape):
            return np.frombuffer(b"".join(todo.column(c).to_pylist()), dtype=kind).reshape(-1, *shape)

        a = _Anchors(join("hashes", np.uint64), join("docs", np.int64, 2), join("places", np.int64), join("bytes", np.uint8, WIDTH))
        part = np.repeat(todo.column("part").to_numpy(), [len(x) // 8 for x in todo.column("hashes").to_pylist()])
        a, new = _Anchors(a.h, a.docs, a.place, a.around, part).sort()
        part = a.part
        later = np.flatnonzero(~new & (a.left + a.right >= LENGTH))
        owner, spans = [part[later]], [np.column_stack((a.docs[later], _around(a, later)))]
        first = np.flatnonzero(new)
        part, a = part[first], a.take(first)
        rank = np.empty(len(part), dtype=np.int64)
        rank[np.lexsort((a.place, a.docs[:, 1], a.docs[:, 0]))] = np.arange(len(part))
        suffix, left = a.around[:, LEFT:], a.around[:, LEFT - 1 :: -1]

        def common(m):
            d = m[1:] != m[:-1]
            return np.where(d.any(axis=1), d.argmax(axis=1), m.shape[1])

        lcp = np.where(a.h[1:] == a.h[:-1], common(suffix), -1) if len(part) > 1 else np.zeros(0, np.int64)
        start = np.flatnonzero(np.append(True, lcp < 0))
        size = np.diff(np.append(start, len(part)))

        def cover(y, o_most, o_least):
            """y repeats the windows that start o_least to o_most bytes before it."""
            o_most = np.minimum(o_most, a.left[y])
            o_least = np.maximum(o_least, LENGTH - a.right[y])
            ok = o_most >= o_least
            y, o_most, o_least = y[ok], o_most[ok], o_least[ok]
            owner.append(part[y])
            spans.append(np.column_stack((a.docs[y], a.place[y] - o_most, a.place[y] - o_least + LENGTH)))

        two = start[size == 2]
        if len(two):
            d = left[two] != left[two + 1]
            ll = np.where(d.any(axis=1), d.argmax(axis=1), LEFT)
            cover(np.where(rank[two] < rank[two + 1], two + 1, two), ll, LENGTH - lcp[two])
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for i, j, length, above in intervals(lcp[s : s + n - 1].tolist()):
                o_least, o_most = LENGTH - length, min(LEFT, LENGTH - above - 1)
                if o_least > o_most:
                    continue
                group = np.arange(s + i, s + j + 1)
                if (left[group, :o_most] == left[group[0], :o_most]).all():  # no left diversity: a maximal repeat
                    y = group[rank[group] != rank[group].min()]
                    cover(y, np.full(len(y), o_most), o_least)
                else:
                    far = _farthest_left(rank[group], left[group])
                    y = far >= o_least
                    cover(group[y], np.minimum(far[y], o_most), o_least)
        owner, spans = np.concatenate(owner), np.concatenate(spans)
        o = np.argsort(owner, kind="stable")
        owner, spans = owner[o], spans[o]
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        for x, y in zip(begin, np.append(begin[1:], len(owner)), strict=False):
            rows.append((int(owner[x]), np.ascontiguousarray(spans[x:y, :2]).tobytes(), np.ascontiguousarray(spans[x:y, 2:]).tobytes()))
    return _table(rows, ["part", "docs", "spans"], [pa.int32(), pa.binary(), pa.binary()])


def _cut_out(docs: pa.Table, notes: pa.Table) -> pa.Table:
    copies = _skipped(notes)
    spans: dict[tuple, np.ndarray] = {}
    blobs = [(d, s) for d, s in zip(notes.column("docs").to_pylist(), notes.column("spans").to_pylist(), strict=True) if d]
    if blobs:
        d = np.frombuffer(b"".join(x for x, _ in blobs), dtype=np.int64).reshape(-1, 2)
        s = np.frombuffer(b"".join(x for _, x in blobs), dtype=np.int64).reshape(-1, 2)
        o = np.lexsort((s[:, 0], d[:, 1], d[:, 0]))
        d, s = d[o], s[o]
        begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]).any(axis=1)))
        for a, b in zip(begin, np.append(begin[1:], len(d)), strict=True):
            spans[(int(d[a, 0]), int(d[a, 1]))] = s[a:b]
    out, results = {c.split()[0]: [] for c in RESULT.split(", ")}, {}
    for b in docs.to_batches(max_chunksize=1024):
        for i, h, text in zip(b.column("doc_id").to_pylist(), b.column("h1").to_pylist(), b.column("text").to_pylist(), strict=True):
            key = (_NO_ID if i is None else i, h)
            if key not in results:
                results[key] = _one((text or "").encode(), spans.get(key), key in copies)
            for c, v in zip(out, (i, *results[key]), strict=True):
                out[c].append(v)
    return pa.table(out, schema=pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string())]))


def _one(raw: bytes, spans: np.ndarray | None, copy: bool) -> tuple:
    if copy and len(raw) >= LENGTH:
        return len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()
    if spans is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    end = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > end[:-1])
    lo, hi = spans[new, 0], np.append(end[np.flatnonzero(new)[1:] - 1], end[-1])
    kept, at = hashlib.sha256(), 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return len(raw), int((hi - lo).sum()), len(lo), kept.hexdigest()


def _parts(spark, size: int | None) -> int:
    return max(2 * shuffle_partitions(spark), -(-(size or 0) // PART_BYTES))


def parts_for(docs: DataFrame) -> int:
    """The number of parts and buckets for a table with a column text: at least twice the shuffle partitions, and of PART_BYTES bytes of text each."""
    return _parts(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(_NO_ID))
    hashed = docs.withColumn("h1", F.xxhash64("text"))
    light = cut(hashed.select(order.alias("copy_id"), F.col("h1").alias("copy_h1"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.octet_length("text").alias("n")))
    parts = buckets = _parts(docs.sparkSession, light.agg(F.sum("n")).first()[0])

    def part(i, h):
        return F.pmod(F.xxhash64(i, h), F.lit(parts)).cast("int").alias("part")

    keyed = hashed.withColumn("part", part(order, "h1"))
    same = ["copy_h1", "crc", "n"]
    first = light.groupBy(*same).agg(F.min("copy_id").alias("first"), F.max("copy_id").alias("last")).where("first < last")
    copies = cut(light.join(first, same).where("copy_id > first").select(part("copy_id", "copy_h1"), F.lit(None).cast("binary").alias("hashes"), "copy_id", "copy_h1").distinct())
    texts = keyed.select("part", "doc_id", "h1", "text").groupBy("part")
    hashes = texts.cogroup(copies.groupBy("part")).applyInArrow(_send_hashes(buckets), BY_BUCKET)
    notes = hashes.groupBy("bucket").applyInArrow(_repeated, NOTES).unionByName(copies)
    around = texts.cogroup(notes.groupBy("part")).applyInArrow(_send_surroundings(buckets), AROUND)
    spans = around.groupBy("bucket").applyInArrow(_repeats, SPANS)
    last = spans.unionByName(copies.select("part", "copy_id", "copy_h1"), allowMissingColumns=True)
    return texts.cogroup(last.groupBy("part")).applyInArrow(_cut_out, RESULT)
