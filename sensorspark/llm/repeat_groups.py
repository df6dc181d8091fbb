"""Maximal repeat groups: every repeated passage of the documents with all its occurrences, from interval trees over anchored suffixes.

A place stands for the LENGTH-byte string that begins there; places of equal strings are a class. Where the next byte's class is the same places moved by one,
both belong to one passage. A group is such a passage grown as far as it goes: at both ends the next string occurs at other places, more of them, or none. So each
repeated place is in exactly one group, groups are linear in the input, and the bytes that remove_repeats cuts are those of all occurrences but each group's first.

1. hashes of anchors that occur twice are found as in suffix_dedup;
2. a part sums its anchors of equal surroundings (only the strings that choose this anchor count) into one row: how often, and linear sums of the documents' random
   values r and of r * place, which tell sets of places apart whatever their common shift;
3. for each hash the suffixes are sorted, a stack scan yields the interval tree, and within an interval a second tree over the left sides tells the left extensions
   apart; each pair of nodes is a class over a run of offsets, with its sums and its first occurrence;
4. runs of one first document whose sums agree and that touch are one group (a window over that document's runs);
5. the group's first run is joined with the rows that were summed into it: its occurrences.

Order of occurrences: doc_id (nulls last), then the hash of the text, then the byte. Null and empty texts and texts under LENGTH bytes have no repeats. Rows that repeat a doc_id and a text are
one document. Extra columns are ignored; an empty table has no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix, powers
from .suffix_dedup import _NO_ID, BY_BUCKET, GRAM, LEFT, LENGTH, NOTES, PAD, WIDTH, _Anchors, _documents, _repeated, _send_hashes, anchors, intervals, parts_for

PLACES = "bucket int, h long, doc long, h1 long, place long, rdoc long, rh1 long, rplace long, around binary, n long, r long, m long"
RUNS = "fdoc long, fh1 long, lo long, hi long, n long, r long, m long, h long, rdoc long, rh1 long, rplace long, most int"


def _random(docs: np.ndarray) -> np.ndarray:
    return mix(docs[:, 0].astype(np.uint64) ^ mix(docs[:, 1].astype(np.uint64)))


def chosen(around: np.ndarray) -> np.ndarray:
    """Surroundings without the bytes that only strings choosing another anchor hold."""
    if not len(around):
        return around
    up, down = powers(WIDTH + 1)
    h = np.zeros((len(around), WIDTH + 1), dtype=np.uint64)
    np.cumsum((around.astype(np.uint64) + np.uint64(1)) * up[:WIDTH], axis=1, out=h[:, 1:])
    g = mix((h[:, GRAM:] - h[:, :-GRAM]) * down[: WIDTH - GRAM + 1]) >> np.uint64(32)
    own = g[:, LEFT : LEFT + 1]

    def run(ok):
        return np.where(ok.all(axis=1), ok.shape[1], (~ok).argmax(axis=1))

    real_left = LEFT - (around[:, :LEFT] == PAD).sum(axis=1)
    real_right = LENGTH - (around[:, LEFT:] == PAD).sum(axis=1)
    most = np.minimum(run((g[:, :LEFT] > own)[:, ::-1]), real_left)
    least = np.maximum(LEFT - run(g[:, LEFT + 1 :] >= own), LENGTH - real_right)
    at = np.arange(WIDTH)
    inside = (at >= (LEFT - most)[:, None]) & (at < (LEFT - least + LENGTH)[:, None]) & (most >= least)[:, None]
    return np.where(inside, around, np.uint8(PAD))


def _send_places(buckets: int):
    kinds = [("bucket", pa.int32()), *[(c, pa.int64()) for c in ("h", "doc", "h1", "place", "rdoc", "rh1", "rplace")], ("around", pa.binary()), *[(c, pa.int64()) for c in ("n", "r", "m")]]

    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        blobs = [x for x in notes.column("hashes").to_pylist() if x]
        got = []
        if blobs and len(docs):
            known = np.unique(np.frombuffer(b"".join(blobs), dtype=np.uint64))
            for i, h1, d in _documents(docs, set()):
                at, h = anchors(d)
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                at, h = at[known[k] == h], h[known[k] == h]
                if len(at):
                    index = at[:, None] + np.arange(-LEFT, LENGTH)
                    inside = (index >= 0) & (index < len(d))
                    around = np.where(inside, d[np.clip(index, 0, len(d) - 1)], np.uint8(PAD))
                    got.append((h, np.tile(np.array([[i, h1]], dtype=np.int64), (len(at), 1)), at, chosen(around)))
        if not got:
            return pa.table([pa.array([], k) for _, k in kinds], names=[c for c, _ in kinds])
        a, new = _Anchors(*[np.concatenate(c) for c in zip(*got, strict=True)]).sort()
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        rep = first[of]
        r = _random(a.docs)
        sums = [np.add.reduceat(x, first).astype(np.uint64).view(np.int64) for x in (np.ones(len(r), np.uint64), r, r * a.place.astype(np.uint64))]
        around = pa.array([a.around[i].tobytes() if f else None for i, f in enumerate(new.tolist())], pa.binary())
        bucket = ((a.h >> np.uint64(3)) % np.uint64(buckets)).astype(np.int32)
        columns = [bucket, a.h.view(np.int64), a.docs[:, 0], a.docs[:, 1], a.place, a.docs[rep, 0], a.docs[rep, 1], a.place[rep], around, *[pa.array(s[of], mask=~new) for s in sums]]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in columns], schema=pa.schema(kinds))

    return run


def _nodes(common: list[int], whole: int):
    """The interval tree with its leaves: (first, last, length, length of the interval above)."""
    yield from intervals(common)
    for j in range(len(common) + 1):
        above = max(common[j - 1] if j else -1, common[j] if j < len(common) else -1)
        if above < whole:
            yield j, j, whole, above


def _common(m: np.ndarray) -> np.ndarray:
    d = m[1:] != m[:-1]
    return np.where(d.any(axis=1), d.argmax(axis=1), m.shape[1])


def _runs(t: pa.Table) -> pa.Table:
    """Classes over runs of offsets; a row for each part's sum in each class."""
    long = lambda c: t.column(c).to_numpy().astype(np.int64)
    around = np.frombuffer(b"".join(t.column("around").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
    a = _Anchors(long("h").view(np.uint64), np.column_stack((long("rdoc"), long("rh1"))), long("rplace"), around, np.arange(len(t)))
    a, new = a.sort()
    n, r, m = (long(c).view(np.uint64)[a.part] for c in ("n", "r", "m"))
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(a.h))
    total, rs, ms = (np.add.reduceat(x, first) for x in (n, r, m))
    u = a.take(first)
    order = np.empty(len(first), dtype=np.int64)
    order[np.lexsort((u.place, u.docs[:, 1], u.docs[:, 0]))] = np.arange(len(first))
    suffix, left = u.around[:, LEFT:], u.around[:, LEFT - 1 :: -1]
    lcp = np.where(u.h[1:] == u.h[:-1], _common(suffix), -1) if len(first) > 1 else np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, lcp < 0))
    out: list[tuple] = []

    def emit(members: np.ndarray, most: int, least: int):
        most, least = min(most, int(u.left[members[0]])), max(least, LENGTH - int(u.right[members[0]]))
        times = int(total[members].sum())
        if most < least or times < 2:
            return
        f = members[order[members].argmin()]
        place, rr = int(u.place[f]), rs[members].sum(dtype=np.uint64)
        moved = ms[members].sum(dtype=np.uint64) - rr * np.uint64(place)
        head = (int(u.docs[f, 0]), int(u.docs[f, 1]), place - most, place - least, times, int(rr.view(np.int64)), int(moved.view(np.int64)), int(u.h[f].view(np.int64)))
        for k in members.tolist():
            for row in range(first[k], ends[k]):
                out.append((*head, int(a.docs[row, 0]), int(a.docs[row, 1]), int(a.place[row]), most))

    with np.errstate(over="ignore"):
        for s, e in zip(start.tolist(), np.append(start[1:], len(first)).tolist(), strict=True):
            if e - s == 1:
                emit(np.array([s]), LEFT, 0)
                continue
            for i, j, length, above in _nodes(lcp[s : e - 1].tolist(), LENGTH):
                least, most = max(0, LENGTH - length), min(LEFT, LENGTH - above - 1)
                if least > most:
                    continue
                group = np.arange(s + i, s + j + 1)
                group = group[np.lexsort(left[group].T[::-1])]
                for x, y, shared, higher in _nodes(_common(left[group]).tolist() if len(group) > 1 else [], LEFT):
                    if max(least, higher + 1) <= min(most, shared):
                        emit(group[x : y + 1], min(most, shared), max(least, higher + 1))
    kinds = [(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in RUNS.split(", ")]
    return pa.table([pa.array(list(c), k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for _, k in kinds], names=[c for c, _ in kinds])


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each occurrence of each group: group_id, n_occurrences, n_bytes, doc_id, start (byte), first (whether it is the group's first)."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = buckets = parts_for(docs)
    keyed = docs.withColumn("h1", F.xxhash64("text")).withColumn("part", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(parts)).cast("int"))
    texts = keyed.select("part", "doc_id", "h1", "text").groupBy("part")
    none = docs.sparkSession.createDataFrame([], NOTES)
    hashes = texts.cogroup(none.groupBy("part")).applyInArrow(_send_hashes(buckets), BY_BUCKET)
    notes = hashes.groupBy("bucket").applyInArrow(_repeated, NOTES)
    places = cut(texts.cogroup(notes.groupBy("part")).applyInArrow(_send_places(buckets), PLACES))
    runs = cut(places.where("n IS NOT NULL").groupBy("bucket").applyInArrow(_runs, RUNS))
    # runs of one first document that touch and have the same places, but for a shift, are one group
    chain = Window.partitionBy("fdoc", "fh1", "n", "r", "m").orderBy("lo")
    distinct = runs.groupBy("fdoc", "fh1", "lo", "n", "r", "m").agg(F.max("hi").alias("hi"))
    gap = F.coalesce(F.col("lo") > F.lag("hi").over(chain) + 1, F.lit(True)).cast("int")
    groups = distinct.withColumn("gap", gap).withColumn("island", F.sum("gap").over(chain)).groupBy("fdoc", "fh1", "n", "r", "m", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = groups.select("fdoc", "fh1", "lo", F.col("n").alias("n_occurrences"), (F.col("hi") - F.col("lo") + LENGTH).alias("n_bytes"))
    rep = ["h", "rdoc", "rh1", "rplace"]
    members = runs.select("fdoc", "fh1", "lo", *rep, "most").join(groups, ["fdoc", "fh1", "lo"])
    found = members.join(places.select(*rep, "doc", "h1", "place"), rep).withColumn("start", F.col("place") - F.col("most"))
    first = (F.col("doc") == F.col("fdoc")) & (F.col("h1") == F.col("fh1")) & (F.col("start") == F.col("lo"))
    return found.select(F.md5(F.concat_ws(" ", "fdoc", "fh1", "lo")).alias("group_id"), "n_occurrences", "n_bytes", F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "start", first.alias("first"))
