"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

How it works, and why nothing is lost:

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature of MinHash values
   of 16 bits. Documents with equal sets form a class; only the class's smallest id goes on.
2. Signatures are split into n chunks of 4 (or 3) values, and each chunk is indexed under its leave-one-out keys (the allowed chunk errors,
   enumerated), so a pair meets if it differs in at most 1 value in some chunk: by the pigeonhole principle every pair
   with fewer than 2 n errors in all does.
3. Members of a key are compared by the whole signature in bounded blocks, and pairs with at most a number of errors are candidates. That number
   is less than 2 n, so all pairs under the signature-distance threshold are found. It and n follow from the percentage asked for (layout): a pair that is just alike
   enough exceeds it in at most 1 of a million cases. At 85 % they are 17 errors of 36 values in 9 chunks. Only a spanning forest of the pairs
   leaves a task: at most one edge for each member, however large the group is.
4. Components of those edges are clusters; every true link lies inside one. Pages of one template, alike but not alike enough, make large ones without
   a link. So members of clusters of more than one block are compared by WIDE values first, and what can't be alike enough by these goes no further; the bound
   of errors again costs a pair that is just alike enough 1 in a million. Components of what is left are clusters in turn.
5. Each cluster's full shingle sets are compared in bounded blocks of members, exactly, and again a spanning forest of the confirmed links leaves each
   task. Their components are the result.

Groups larger than a block are dealt out as pairs of blocks over many tasks. Nothing is capped.

Defined results: null, empty or blank texts have n_shingles 0, their own doc_id as component and are kept; rows that repeat a
doc_id and a text get the same result each; an id that
repeats with other texts stands for all of them. A null doc_id never links: its component is null and it is kept. Extra columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, components, cut, mix, prefix_hashes, small, span_hashes, words

SHINGLE = 5
MOST_VALUES, LEAST_CHUNKS = 256, 6
MISS = 1e-6  # share of the pairs just alike enough that exceed the bound of errors
SMALL = 500_000  # rows of ids (16 bytes each) or signatures (about 100 bytes each) up to which a counted table is broadcast
WIDE = 256  # values that members of large clusters are compared by before their sets are
KEY_BLOCK = 4096  # members of a key whose signatures meet in one task, at most two blocks at a time
BLOCK, BLOCK_SHINGLES = 512, 1 << 21  # members of a cluster, and shingles of them, that meet in one task, at most two blocks at a time

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULT = _rng.integers(1, 2**63, MOST_VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array):
    """Yields for each text, in order, its sorted distinct shingle hashes."""
    for _, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, row = words(data, offsets)
        h = span_hashes(prefix_hashes(data), starts, ends)
        n = len(offsets) - 1
        first = np.searchsorted(row, np.arange(n + 1))
        if len(h) >= SHINGLE:
            m = len(h) - SHINGLE + 1
            whole = mix(sum(h[i : i + m] * _PART[i] for i in range(SHINGLE)))
        for i in range(n):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= SHINGLE:
                yield np.unique(whole[lo : hi - SHINGLE + 1])
            elif hi > lo:  # the whole sequence is one shingle; its length is part of it
                yield mix((h[lo:hi] * _PART[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
            else:
                yield h[:0]


def signature(s: np.ndarray, values: int) -> np.ndarray:
    best = np.full(values, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(s), 2048):
        np.minimum(best, (s[lo : lo + 2048] * _MULT[:values, None]).min(axis=1), out=best)
    return mix(best).astype(np.uint16)


SIGNED = "doc_id long, n_shingles long, set1 long, set2 long, sig binary"


def _sign(values: int):
    def run(batches):
        for b in batches:
            ids, n, one, two, sig = b.column(0), [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                one.append(mix(s).sum(dtype=np.uint64))
                two.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sig.append(signature(s, values).tobytes() if len(s) else None)
            as_long = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), as_long(one), as_long(two), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set1", "set2", "sig"])

    return run


def errors_of(values: int, percent: int) -> int:
    """The errors of so many values that a pair just alike enough exceeds in at most a share MISS of the cases."""
    p, tail, errors = percent / 100, 0.0, values
    while errors > 0:
        tail += comb(values, errors) * (1 - p) ** errors * p ** (values - errors)
        if tail > MISS:
            break
        errors -= 1
    return errors


def layout(percent: int) -> tuple[int, int, int]:
    """Chunks of the signature, values of a chunk, and errors within which a pair is a candidate: fewer than two for each chunk."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}")
    for size in (4, 3):  # keys of fewer than two values would be shared by chance
        for n in range(LEAST_CHUNKS, MOST_VALUES // size + 1):
            v = n * size
            if (errors := errors_of(v, percent)) < 2 * n:
                return n, size, errors
    raise ValueError(f"{MOST_VALUES} values can't find pairs that share {percent} %")


def _keys(chunks_: int, chunk: int):
    def run(batches):
        """Leave-one-out keys of each chunk of the signature."""
        indexed = chunks_ * chunk
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                sig = np.stack([np.frombuffer(x, dtype=np.uint16)[:indexed] for x in part.column(1).to_pylist()]).astype(np.uint64)
                keys = []
                for c in range(0, indexed, chunk):
                    for skip in range(chunk):
                        key = np.full(len(sig), c * chunk + skip + 1, dtype=np.uint64)
                        for i in range(chunk):
                            if i != skip:
                                key = (key << np.uint64(16)) ^ sig[:, c + i] ^ (key >> np.uint64(48))
                        keys.append(mix(key * np.uint64(0x2545F4914F6CDD1D) + np.uint64(c * chunk + skip)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(part.column(0).to_numpy(), len(keys)))], names=["key", "doc_id"])

    return run


def _forest(ids: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric relation; near(i, others) tells which of others i is related to."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            new, left = left[hit], left[~hit]
            edges += [(int(ids[i]), int(ids[j])) for j in new]
            queue += new.tolist()
    return edges


def _edges(edges) -> pa.Table:
    a = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": a[:, 0], "b": a[:, 1]})


def _wide(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            sig = pa.array([signature(s, WIDE).tobytes() for s in shingle_sets(part.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sig], names=["doc_id", "cluster", "sig"])


def parted(docs: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """clusters (doc_id, cluster, n) with those of more than a block of members replaced by what hangs together of them by WIDE values; members left alone are gone."""
    big = clusters.groupBy("cluster").count().where(F.col("count") > BLOCK).select("cluster", F.ceil(F.col("count") / KEY_BLOCK).alias("blocks"))
    big = cut(big)
    members = clusters.join(small(big, SMALL), "cluster")
    wide = docs.join(small(cut(members.select("doc_id", "cluster", "blocks")), SMALL), "doc_id").select("doc_id", "cluster", "text", "blocks")
    wide = wide.select("doc_id", "cluster", "text").mapInArrow(_wide, "doc_id long, cluster long, sig binary").join(small(big, SMALL), "cluster")
    met = _in_blocks(wide, "blocks").select("cluster", "x", "y", "doc_id", "sig")
    near = met.groupBy("cluster", "x", "y").applyInArrow(_near_signatures(errors_of(WIDE, percent)), "a long, b long").distinct()
    again = components(near).select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
    return clusters.join(small(big, SMALL).select("cluster"), "cluster", "left_anti").unionByName(again.join(members.select("doc_id", "n"), "doc_id"))


def _near_signatures(errors: int):
    def run(t: pa.Table) -> pa.Table:
        sig = np.stack([np.frombuffer(x, dtype=np.uint16) for x in t.column("sig").to_pylist()])
        return _edges(_forest(t.column("doc_id").to_numpy(), lambda i, others: (sig[others] != sig[i]).sum(axis=1) <= errors))

    return run


def _linked(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Exact: the sizes of all intersections, as a matrix product over the shingles that more than one member has."""
        ids = t.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        who = np.repeat(np.arange(len(sets)), size)
        _, what, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[what] > 1
        number = np.cumsum(times > 1) - 1
        who, what = who[common], number[what[common]]
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        step = max(256, (1 << 22) // max(1, len(sets)))
        for lo in range(0, int(what[-1]) + 1 if len(what) else 0, step):
            i, j = np.searchsorted(what, [lo, lo + step])
            has = np.zeros((len(sets), step), dtype=np.float32)
            has[who[i:j], what[i:j] - lo] = 1
            both += has @ has.T
        both = both.astype(np.int64)
        union = size[:, None] + size[None, :] - both
        linked = 100 * both >= percent * union
        return _edges(_forest(ids, lambda i, others: linked[i, others]))

    return run


def _in_blocks(members: DataFrame, blocks: str) -> DataFrame:
    """Adds block columns (x, y) from the number of blocks of a member's group: a group of several meets as pairs of blocks, each over many tasks; every pair of members meets in some pair of blocks."""
    n = F.col(blocks).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(7)), n).cast("int")
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.least(i, mine).alias("x"), F.greatest(i, mine).alias("y")))
    return members.withColumn("_p", F.explode(F.when(n > 1, others).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))))).select("*", "_p.x", "_p.y").drop("_p", blocks)


def candidates(signed: DataFrame, n: int, size: int, errors: int) -> DataFrame:
    """a, b: edges whose components hold every pair of doc_ids with at most so many errors in sig; fewer than 2 n, the chunks."""
    keys = signed.mapInArrow(_keys(n, size), "key long, doc_id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / KEY_BLOCK).alias("blocks"))
    met = _in_blocks(keys.join(shared, "key"), "blocks").join(small(signed, SMALL), "doc_id")
    return met.select("key", "x", "y", "doc_id", "sig").groupBy("key", "x", "y").applyInArrow(_near_signatures(errors), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept. percent: of the union that two sets must share."""
    n, size, errors = layout(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(docs.mapInArrow(_sign(n * size), SIGNED))
    light = signed.select("doc_id", "n_shingles", "set1", "set2")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    # an id may have several texts; it then stands for all of them
    reps = cut(some.select("doc_id", "n_shingles", "set1", "set2", "sig").join(classes, ["set1", "set2"]).where("doc_id = rep").select("doc_id", "n_shingles", "sig").distinct())
    near = candidates(reps.select("doc_id", "sig"), n, size, errors)
    clusters = components(near).withColumnsRenamed({"node": "doc_id", "label": "cluster"})
    clusters = cut(clusters.join(reps.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), "doc_id"))
    clusters = cut(parted(docs, clusters, percent))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("blocks"))
    sets = docs.join(small(clusters.select("doc_id", "cluster"), SMALL), "doc_id").select("doc_id", "cluster", "text").mapInArrow(_shingles, "doc_id long, cluster long, shingles binary")
    met = _in_blocks(sets.join(sizes, "cluster"), "blocks")
    links = met.groupBy("cluster", "x", "y").applyInArrow(_linked(percent), "a long, b long")
    same = some.select("doc_id", "set1", "set2").distinct().join(classes, ["set1", "set2"]).select("doc_id", "rep")
    label = components(links.unionAll(same.where("doc_id <> rep")).distinct()).withColumnRenamed("node", "doc_id")
    out = light.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; of rows that repeat a doc_id one stays. All columns of docs."""
    found = cut(near_duplicates(docs, percent=percent))
    gone = cut(found.where("NOT kept").select("doc_id").distinct())
    repeated = cut(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    docs = docs.join(small(gone, SMALL), "doc_id", "left_anti")
    if repeated.count():
        # columns of any type, also those without an order: of equal hashes of a row any row will do
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        once = docs.join(small(repeated, SMALL), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row")).select("_row.*")
        docs = docs.join(small(repeated, SMALL), "doc_id", "left_anti").unionByName(once)
    return docs


def _shingles(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            sets = pa.array([s.tobytes() for s in shingle_sets(part.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], names=["doc_id", "cluster", "shingles"])
