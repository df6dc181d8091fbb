"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text's fingerprint is the sum of wide vectors, one for each paragraph (what newlines separate):

* 16 lanes modulo 2**32 from a keyless 512-bit hash of the paragraph, for equality;
* 128 lanes modulo 2**16 that add +1 or -1 at a hashed place for every run of three words of the paragraph (a shorter paragraph
  is one run), for likeness: the squared length of a difference of such sums estimates how many runs differ.

Sums don't depend on the paragraphs' order, and inserting or deleting a paragraph adds or subtracts its vector (`insert`,
`delete`): no text is read again. Equal multisets of paragraphs, so equal texts, have equal fingerprints.

Defined results: null and empty texts have no paragraph, n_chars 0 and the zero fingerprint; likeness of equal fingerprints is 1, of
a zero and another fingerprint 0. Neighbours are taken in descending (doc_id, nulls last), ties in ascending text, so
repeated rows follow each other; a table of one row has that row as its own neighbour. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, prefix_hashes, shuffle_partitions, span_hashes, words

WIDE, LANES, RUN = 16, 128, 3
_rng = np.random.Generator(np.random.PCG64(16))
_PART = _rng.integers(1, 2**63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The equality lanes (uint32) and likeness lanes (int16) of each text."""
    wide, like = [np.zeros((0, WIDE), np.uint32)], [np.zeros((0, LANES), np.int16)]
    for _, data, offsets in chunks(texts):
        n, raw = len(offsets) - 1, data.tobytes()
        if not raw:
            wide.append(np.zeros((n, WIDE), np.uint32))
            like.append(np.zeros((n, LANES), np.int16))
            continue
        breaks = np.flatnonzero(data == 10)
        length = np.diff(offsets)
        # paragraphs start at texts that aren't empty and after newlines
        starts = np.unique(np.concatenate((offsets[:-1][length > 0], breaks + 1)))
        starts = starts[starts < len(data)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.append(starts[1:], len(data)) - np.isin(np.append(starts[1:], len(data)) - 1, breaks)
        # a newline at the end of a text is followed by an empty paragraph, which has no byte to start at
        tail = breaks[np.isin(breaks + 1, offsets[1:])]
        digests = [hashlib.blake2b(raw[a:b], digest_size=4 * WIDE).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        digests += [hashlib.blake2b(b"", digest_size=4 * WIDE).digest()] * len(tail)
        whose = np.concatenate((row, np.searchsorted(offsets, tail, side="right") - 1))
        lanes = np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, WIDE)
        w = np.zeros((n, WIDE), dtype=np.uint32)
        np.add.at(w, whose, lanes)
        wide.append(w)
        s, e, r = words(data, offsets)
        h, p = span_hashes(prefix_hashes(data), s, e), np.searchsorted(starts, s, side="right")
        m = len(h) - RUN + 1
        runs, of = [], []
        if m > 0:
            ok = p[:m] == p[RUN - 1 :]
            runs.append(mix(sum(h[i : i + m] * _PART[i] for i in range(RUN)))[ok])
            of.append(r[:m][ok])
        if len(p):
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            count = np.diff(np.append(first, len(p)))
            for k in range(1, RUN):
                f = first[count == k]
                runs.append(mix(sum((h[f + i] * _PART[i] for i in range(k)), start=np.full(len(f), k, np.uint64))))
                of.append(r[f])
        if runs:
            t, of = np.concatenate(runs), np.concatenate(of)
            place, sign = (t & np.uint64(LANES - 1)).astype(np.int64), ((t >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1
            sums = np.bincount(of * LANES + place, weights=sign, minlength=n * LANES).reshape(n, LANES).astype(np.int64)
        else:
            sums = np.zeros((n, LANES), dtype=np.int64)
        like.append(sums.astype(np.uint16).view(np.int16))
    return np.concatenate(wide), np.concatenate(like)


def to_text(wide: np.ndarray, like: np.ndarray) -> list[str]:
    return [a.astype("<u4").tobytes().hex() + b.astype("<i2").tobytes().hex() for a, b in zip(wide, like, strict=True)]


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 4 * WIDE], "<u4"), np.frombuffer(raw[4 * WIDE :], "<i2")


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of a text with one more paragraph."""
    return _add(fingerprint, paragraph, 1)


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of a text without one of its paragraphs."""
    return _add(fingerprint, paragraph, -1)


def _add(fingerprint: str, paragraph: str, sign: int) -> str:
    if "\n" in paragraph:
        raise ValueError("a paragraph is one line")
    (w, s), (x, t) = from_text(fingerprint), vectors(pa.array([paragraph])) if paragraph else _empty()
    x, t = x[0].astype(np.int64), t[0].astype(np.int64)
    return to_text((w.astype(np.int64) + sign * x).astype(np.uint32)[None], (s + sign * t).astype(np.uint16).view(np.int16)[None])[0]


def _empty() -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the empty paragraph, which has no runs of words."""
    return np.frombuffer(hashlib.blake2b(b"", digest_size=4 * WIDE).digest(), "<u4")[None], np.zeros((1, LANES), np.int16)


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """Of pairs of fingerprints, 0 to 1: about 1 less the share of runs of words that one of the texts lacks."""
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    d = ((a[1].astype(np.int32) - b[1]).astype(np.uint16).view(np.int16).astype(np.float64) ** 2).sum(axis=1)
    total = (x**2).sum(axis=1) + (y**2).sum(axis=1)
    return np.where(same, 1.0, np.clip(1 - d / np.maximum(total, 1), 0, 1) * (total > 0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""

    def run(batches):
        for b in batches:
            texts = b.column(1)
            n = pa.array([len(x or "") for x in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(to_text(*vectors(texts)), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _search(bounds: list[int], key):
    """The number of bounds that are at most key, by halving steps over an array: the expression doesn't grow with their number."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    fits = lambda at: (at <= len(bounds)) & (F.get(table, at - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its code points replaced by the first as many of the next text.

    The rows are dealt out once, by ranges of ids; each range also gets the first row of the next range, so every text
    meets its neighbour without a global order in one task. The driver holds the ranges' bounds only.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = 2 * shuffle_partitions(docs.sparkSession)
    cuts = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)
    bounds = sorted({int(x) for x in cuts})
    docs = docs.withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(_search(bounds, F.col("doc_id"))))
    tops = sorted(docs.groupBy("block").agg(F.max("doc_id").alias("top")).collect(), reverse=True)  # at most n + 1 rows
    halo = docs.sparkSession.createDataFrame([(r.block, r.top, tops[i - 1].block) for i, r in enumerate(tops)], "block int, top long, before int")
    own = docs.select("block", F.lit(0).alias("halo"), "doc_id", "text")
    # one row for each range, however often its largest id repeats: the first by text, nulls first
    first = docs.join(F.broadcast(halo), "block").where(F.col("doc_id").eqNullSafe(F.col("top")) & F.col("before").isNotNull())
    first = first.groupBy("before").agg(F.max("doc_id").alias("doc_id"), F.min(F.struct(F.col("text").isNotNull().alias("k"), "text")).alias("m")).select(F.col("before").alias("block"), F.lit(1).alias("halo"), "doc_id", "m.text")
    rows = own.unionByName(first).repartition(shuffle_partitions(docs.sparkSession), "block")
    return rows.sortWithinPartitions("block", "halo", F.desc_nulls_last("doc_id"), "text").mapInArrow(_compare, RESULT)


def _compare(batches):
    held = None  # block, halo, id, text and fingerprint of the last row, whose neighbour is yet to come
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            b = whole.slice(lo, 512)
            wide, like = vectors(b.column(3))
            block, halo, ids, texts = (c.to_pylist() for c in b.columns)
            texts = [t or "" for t in texts]
            if held:
                block, halo, ids, texts = [held[0], *block], [held[1], *halo], [held[2], *ids], [held[3], *texts]
                wide, like = np.concatenate((held[4], wide)), np.concatenate((held[5], like))
            keep = np.array([i for i in range(len(ids) - 1) if not halo[i]], dtype=np.int64)  # a range's last own row is followed by its halo
            held = (block[-1], halo[-1], ids[-1], texts[-1], wide[-1:], like[-1:])
            if not len(keep):
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in keep]
            x = vectors(pa.array(edited, pa.large_string()))
            mine, after = (wide[keep], like[keep]), (wide[keep + 1], like[keep + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited])]
                + [pa.array(to_text(*mine)), pa.array(to_text(*x)), pa.array(likeness(mine, x)), pa.array(likeness(mine, after))],
                names=[f.split()[0] for f in RESULT.split(", ")],
            )
