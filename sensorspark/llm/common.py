"""Helpers shared by the corpus operators: chunked text views, hashing, components, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Texts are hashed in runs of rows of about this many bytes, so a worker's memory doesn't follow the Arrow batch.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that carries whole texts; Spark's 10,000 make buffers of tens of MB in the JVM and in each worker, which both keep.
BATCH_ROWS = 500
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] the weighted sum of bytes i to j-1; see span_hashes."""
    up, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the byte spans [start, end)."""
    _, down = powers(len(h))
    return mix((h[ends] - h[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words in consecutive texts; words never cross texts."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    after = np.concatenate((solid[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yields (first row, bytes of the rows' texts, their offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor takes nothing with it."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of at most BATCH_ROWS; the session's own setting holds again afterwards."""
    before = spark.conf.get(BATCHES)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df (cheap to count, so written before) marked for broadcast if it has at most so many rows, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges, for every node that has an edge.

    Alternates large-star and small-star steps: each node links its larger (then smaller) neighbours to its smallest
    one, which keeps the number of edges and at least halves the depth of trees. Sums are combined before each
    shuffle except for the neighbour lists, which joins stream instead of collecting. Ends when a step changes nothing.
    """
    e = cut(edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")).where("lo < hi").distinct())
    before = None
    while True:
        # large star: from every node, neighbours larger than it go to the smallest neighbour (or the node itself)
        both = e.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionAll(e.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("root"))
        large = both.where("m > n").join(least, "n").select(F.col("root").alias("lo"), F.col("m").alias("hi")).where("lo < hi").distinct()
        # small star: from every node, smaller neighbours go to the smallest of them
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(root, "hi").select("root", F.explode(F.array("lo", "hi")).alias("hi")).where("root < hi").select(F.col("root").alias("lo"), "hi").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
