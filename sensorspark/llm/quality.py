"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Statistics come from whole texts, by numpy over runs of rows. The trees are fitted on the driver from a sample of labelled rows of a bounded,
documented size (MAX_SAMPLE, those with the smallest hash of their id); scoring visits every text and walks all rows of a run through a
tree's arrays at once.

Defined results: null and empty texts get the score of their (zero) statistics; labels that are null or neither 0 nor 1 are left out,
and an id with both counts as 1; with no labels, or one kind only, every score is the smoothed share of label 1 (0.5 without labels).
Repeated rows get equal scores. A null doc_id counts as the empty text for the fold. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prefix_hashes, span_hashes, words

MAX_SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAF, RIDGE = 64, 120, 4, 0.12, 2.0, 1.0

#: Classes of bytes that are counted: lower case, upper case, digits, blanks, newlines, full stops and commas, brackets and quotes, then others.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".", ",;:", "!", "?", "#$%&*+=@^~", "|/\\_<>{}[]", "()'\"`-"]
_KIND = np.full(256, len(_KINDS), dtype=np.uint8)
for _i, _chars in enumerate(_KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i
_KIND[128:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
    return np.bincount(row[at], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    out = [np.zeros((0, N_KINDS + 13))]
    for _, data, offsets in chunks(texts):
        n, size = len(offsets) - 1, np.diff(offsets)
        some = np.maximum(size, 1)
        kinds = np.bincount(np.repeat(np.arange(n), size) * N_KINDS + _KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
        s, e, row = words(data, offsets)
        prefix = prefix_hashes(data)
        h, length = span_hashes(prefix, s, e), e - s
        count = np.bincount(row, minlength=n)
        many = np.maximum(count, 1)
        mean = np.bincount(row, weights=length, minlength=n) / many
        var = np.bincount(row, weights=length.astype(float) ** 2, minlength=n) / many - mean**2
        last, first = _KIND[data[e - 1]] if len(s) else s, _KIND[data[s]] if len(s) else s
        share = lambda m: np.bincount(row[m], minlength=n) / many
        breaks = np.flatnonzero(data == 10)
        starts = np.union1d(offsets[:-1][size > 0], breaks + 1)
        starts = starts[starts < len(data)]
        line_row = np.searchsorted(offsets, starts, side="right") - 1
        line_end = np.append(starts[1:], len(data))
        lines = np.bincount(line_row, minlength=n)
        # pairs of neighbouring words; the last word of a text pairs with nothing
        pair = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
        pairs = (h[:-1] * np.uint64(3) + h[1:])[pair] if len(row) else h
        pair_row = row[:-1][pair] if len(row) else row
        n_pairs = np.bincount(pair_row, minlength=n)
        out.append(
            np.column_stack(
                [
                    kinds / some[:, None],
                    np.log1p(size),
                    np.log1p(count),
                    mean,
                    np.sqrt(np.maximum(var, 0)),
                    _distinct(row, h, n) / many,
                    _distinct(pair_row, pairs, n) / np.maximum(n_pairs, 1),
                    np.log1p(lines),
                    _distinct(line_row, span_hashes(prefix, starts, line_end), n) / np.maximum(lines, 1),
                    count / np.maximum(lines, 1),
                    share(length == 1),
                    share(length > 20),
                    share(last == 9),
                    share(first == 1),
                ]
            )
        )
    return np.concatenate(out)


class Trees:
    """Boosted trees with a logistic loss; after fit, node i of all trees is feature[i], limit[i], below[i] (its right child is next) and value[i]."""

    def __init__(self):
        self.base, self.feature, self.limit, self.below, self.value, self.roots = 0.0, [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) == 2:
            edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
            binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.int64)
            raw = np.full(len(y), self.base)
            for _ in range(TREES):
                p = 1 / (1 + np.exp(-raw))
                self.roots.append(self._node())
                self._grow(self.roots[-1], binned, edges, y - p, p * (1 - p), np.arange(len(y)), 0, raw)
        self.feature, self.below, self.roots = (np.array(v, dtype=np.int64) for v in (self.feature, self.below, self.roots))
        self.limit, self.value = np.array(self.limit, dtype=float), np.array(self.value, dtype=float)
        return self

    def _node(self) -> int:
        for v, x in ((self.feature, 0), (self.limit, np.inf), (self.below, len(self.below)), (self.value, 0.0)):
            v.append(x)
        return len(self.value) - 1

    def _grow(self, node, binned, edges, g, h, rows, depth, raw) -> None:
        total, weight = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth < DEPTH and weight >= 2 * LEAF:
            for f, e in enumerate(edges):
                if len(e):
                    b = binned[rows, f]
                    gl, hl = (np.cumsum(np.bincount(b, weights=v[rows], minlength=len(e) + 1))[:-1] for v in (g, h))
                    gain = gl**2 / (hl + RIDGE) + (total - gl) ** 2 / (weight - hl + RIDGE) - total**2 / (weight + RIDGE)
                    gain[(hl < LEAF) | (weight - hl < LEAF)] = 0
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), f, k), key=lambda t: t[0])
        if best[1] is None:
            self.value[node] = float(RATE * total / (weight + RIDGE))
            raw[rows] += self.value[node]
            return
        _, f, k = best
        a, b = self._node(), self._node()
        self.feature[node], self.limit[node], self.below[node] = f, float(edges[f][k]), a
        right = binned[rows, f] > k
        self._grow(a, binned, edges, g, h, rows[~right], depth + 1, raw)
        self._grow(b, binned, edges, g, h, rows[right], depth + 1, raw)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, every = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                # a leaf is its own child and no value exceeds its limit
                node = self.below[node] + (x[every, self.feature[node]] > self.limit[node])
            raw += self.value[node]
        return 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = MAX_SAMPLE, held_out_fold: int = 0) -> Trees:
    """Trees from labelled documents outside the held-out fold; at most max_sample of them reach the driver, as statistics."""
    seen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    seen = seen.where(fold(F.col("doc_id")) != held_out_fold).groupBy("doc_id").agg(F.max("y").alias("y"))
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches):
        for b in batches:
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = texts.join(F.broadcast(seen), "doc_id").select("doc_id", "y", "text").mapInArrow(measure, "doc_id long, y int, x array<double>")
    got = got.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()  # an id that repeats counts once, so the bound holds
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True))
    return Trees().fit(np.array([r[2] for r in rows]).reshape(len(rows), N_KINDS + 13), np.array([r[1] for r in rows], dtype=float))


def fold(doc_id, folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    texts = docs.select("*") if into not in docs.columns else docs.drop(into)
    names, at = texts.columns, texts.columns.index(text_col)
    model = texts.sparkSession.sparkContext.broadcast(trees)  # some thousand nodes, whatever the input

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.score(statistics(b.column(at))))], names=[*names, into])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField(into, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; fitted on the labelled rows that aren't held out."""
    trees = fit(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), trees)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
