"""Helpers shared by the operators of this package.

Text helpers work on Arrow string buffers: words and their 64-bit hashes come
from a few numpy passes over the bytes of a block of texts, never from a
Python loop per word.  Spark helpers write intermediate tables to the shared
folder, size-check what is broadcast and find connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.session import shared_path

#: Bytes of text that the numpy passes take at once.
BLOCK_BYTES = 1 << 18
#: A side that is broadcast holds at most this many bytes.
BROADCAST_BYTES = 24 << 20

# ---------------------------------------------------------------- Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; what
    the write has shuffled is deleted."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(small: DataFrame, row_bytes: int) -> DataFrame:
    """``small`` (a staged table) with a broadcast hint if its row count proves
    that it stays under ``BROADCAST_BYTES``; else as it is, for a shuffle join
    whose skewed partitions adaptive execution splits."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


#: Rows of an Arrow batch.  Texts of some kilobytes make the default a batch of tens of megabytes.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Cap Arrow batches of this session at ``BATCH_ROWS`` rows (a smaller setting stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a staged table; a, b: non-null longs).

    Returns (id, component) for every id in a link; the component is its
    smallest id.  Alternating large-star and small-star steps: each hangs the
    neighbours of a node on the smallest one, so paths halve and the table
    never grows beyond its links.  Minima are partial aggregates, so a node
    with very many links is no hot spot.  Each step is written to the shared
    folder, which cuts the lineage; nothing is collected.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        # large star: every larger neighbour moves to the smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).where("u != v").distinct()
        small = staged(small, "stars")
        # done when every node has one link, to a node that has none above it
        ends = small.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(small.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
        edges = small
        if ends.where("up > 1 OR up > 0 AND low > 0").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- text side

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64); wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, BLOCK_BYTES) + 1
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about
    ``limit`` bytes; a longer text is a block of its own."""
    data, off = buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    full = ~_SPACE[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    rows = off[:-1][np.diff(off) > 0]
    begins[rows] = full[rows]
    lasts = full.copy()
    lasts[:-1] &= ~full[1:]
    ends = off[1:][np.diff(off) > 0] - 1
    lasts[ends] = full[ends]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(lasts) + 1, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased: (hash, row, start, end).

    A polynomial hash of the bytes, taken from one running sum: a word is the
    difference of two sums times a power of the inverse base.
    """
    start, end, row = word_spans(data, off)
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWERED[data] * up[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64)), row, start, end


def shingle_hashes(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of a row (a shorter row is one run); (hash, row)."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(len(h))[0][:len(h)], dtype=np.uint64)))
    size = np.minimum(count, k)
    n = np.where(count > 0, count - size + 1, 0)
    out_row = np.repeat(np.arange(rows), n)
    at = np.arange(len(out_row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][out_row]
    to = at + size[out_row]
    s = (total[to] - total[at]) * powers(len(h))[1][at]
    return mix(s + size[out_row].astype(np.uint64)), out_row


def parts_for(total_bytes: float, least: int, target: int = 32 << 20) -> int:
    """Number of shuffle groups so that each holds about ``target`` bytes."""
    return max(least, math.ceil(total_bytes / target))
