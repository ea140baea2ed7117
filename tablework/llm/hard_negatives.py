"""Hard negatives by rotated one-bit codes with exact rescoring.

Vectors are integers (``floor(256 * x)`` of each component) and a score is the
inner product of two of them.  For every row, kept once:

* the vector is turned by one fixed random rotation and its signs are the first
  code; the rest of the vector, less its share along that code, has its signs as
  the next code, and so on for ``LEVELS`` codes.  With the codes are stored the
  alignment with each code vector and the length of what is left at the end.

An anchor, turned too, is cut into ``PLANES`` bit planes.  The inner product with
a code vector is then a few popcounts, wrong by no more than the length of what
the planes leave out; what the row's codes leave out adds no more than its length
times that of the anchor (Cauchy-Schwarz).  So each pair gets an interval that is
certain to hold its score.  A row whose interval lies below the k-th best lower
end (or outside the wanted range of scores) can't be among the best; all others
are scored in integers, so results are exact.

Every anchor meets every row: rows are dealt at random into blocks of about
``BLOCK_ROWS``, anchors are sent to every block, and a task holds one block and
streams the anchors past it.  A block hands on its best few per anchor, which a
rank limit merges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm import common as C

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative has between so many and so many hundredths of the positive's score.
LOW, HIGH = 30, 90
LABELS = 10
BLOCK_ROWS = 4096
LEVELS, PLANES = 4, 8
#: Anchors that are held against a block at once.
STRIPE = 32
SEED = 20250131


def anchors_of(vec_id: Column) -> Column:
    return vec_id % 100 == 0


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans (a multiple of 64) as rows of 64-bit words."""
    return np.packbits(signs, axis=-1, bitorder="little").view("<u8")


class Codes:
    """One-bit codes of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        n, dim = vectors.shape
        self.vectors = vectors
        rest = vectors.astype(np.float64) @ rotation(dim).T
        self.words, self.align = [], []
        for _ in range(LEVELS):
            up = rest >= 0
            share = np.abs(rest).sum(1) / math.sqrt(dim)  # along the code vector, which has length 1
            self.words.append(_bits(up))
            self.align.append(share)
            rest = rest - np.where(up, 1.0, -1.0) * (share / math.sqrt(dim))[:, None]
        self.left = np.sqrt((rest * rest).sum(1))
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends (anchors x rows) that hold the inner products."""
        dim = anchors.shape[1]
        turned = anchors.astype(np.float64) @ rotation(dim).T
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
        cut = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        off = np.sqrt(((turned - (low[:, None] + cut * step[:, None])) ** 2).sum(1))
        planes = [_bits((cut >> j & 1).astype(bool)) for j in range(PLANES)]
        inside = [np.bitwise_count(p).sum(1, dtype=np.int64) for p in planes]
        guess = np.zeros((len(anchors), len(self.left)))
        for words, align in zip(self.words, self.align):
            ones = np.bitwise_count(words).sum(1, dtype=np.int64)
            dot = low[:, None] * (2 * ones - dim)[None, :]
            for j, (plane, all_set) in enumerate(zip(planes, inside)):
                both = np.zeros(guess.shape, np.int16)
                for w in range(words.shape[1]):
                    both += np.bitwise_count(words[None, :, w] & plane[:, w, None])
                dot += (step[:, None] * (1 << j)) * (2.0 * both - all_set[:, None])
            guess += dot * (align / math.sqrt(dim))[None, :]
        size = np.sqrt((turned * turned).sum(1))
        width = self.left[None, :] * size[:, None] + sum(self.align)[None, :] * off[:, None]
        width += 1e-9 * self.lengths[None, :] * size[:, None] + 1e-6  # rounding of the doubles above
        return guess - width, guess + width


def _least(low: np.ndarray, k: int) -> float:
    """The k-th largest lower end; nothing below it can be among the first k."""
    return -np.inf if len(low) < k else np.partition(low, len(low) - k)[len(low) - k]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: higher score first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


class _Block:
    """The rows of one block, gathered from the stream."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.codes: Codes | None = None

    def add(self, *cols) -> None:
        self.parts.append(cols)

    def close(self) -> None:
        if self.codes is None:
            cols = [np.concatenate(x) for x in zip(*self.parts)]
            self.rid, self.ids, self.labels, vectors = cols
            self.codes, self.parts = Codes(vectors), []


def _best_positives(block: _Block, rid: int, label: int, anchor: np.ndarray, low, high, _wanted) -> Iterator[tuple]:
    same = np.flatnonzero((block.labels == label) & (block.rid != rid))
    if len(same):
        same = same[high[same] >= _least(low[same], POSITIVES)]
        scores = block.codes.vectors[same] @ anchor
        for k in _first(block.ids[same], scores, POSITIVES):
            yield 0, block.rid[same[k]], block.ids[same[k]], scores[k]


def _best_negatives(block: _Block, rid: int, label: int, anchor: np.ndarray, low, high, wanted) -> Iterator[tuple]:
    other = np.flatnonzero(block.labels != label)
    if not len(other):
        return
    low, high = 100 * low[other], 100 * high[other]
    chosen = []
    for place, score in wanted:
        bottom, top = LOW * score, HIGH * score
        sure = low[(low >= bottom) & (high <= top)]
        chosen.append((place, bottom, top, (high >= max(bottom, _least(sure, NEGATIVES))) & (low <= top)))
    some = np.flatnonzero(np.logical_or.reduce([c[3] for c in chosen])) if chosen else []
    if not len(some):
        return
    ids, scores = block.ids[other[some]], block.codes.vectors[other[some]] @ anchor
    for place, bottom, top, _ in chosen:
        ok = np.flatnonzero((100 * scores >= bottom) & (100 * scores <= top))
        for k in _first(ids[ok], scores[ok], NEGATIVES):
            yield place, block.rid[other[some[ok[k]]]], ids[ok[k]], scores[ok[k]]


_FOUND = "anchor_rid long, anchor_id long, place int, other_rid long, other_id long, score long"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim``; shorter ones end in zeros."""
    sizes = np.asarray(col.value_lengths())
    out = np.zeros((len(col), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = np.asarray(col.flatten())
    return out


def _scan_task(dim: int, best: Callable):
    """Streams (block, kind, rid, vec_id, label, vector, wanted): the rows of a
    block (kind 0), then all anchors (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = _Block(), None
        for batch in batches:
            number, kind, rid, ids, labels = (np.asarray(batch.column(i)) for i in range(5))
            vectors = _matrix(batch.column(5), dim)
            wanted = batch.column(6)
            cuts = np.flatnonzero(np.diff(number) | np.diff(kind)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(number)]):
                if i == j:
                    continue
                if number[i] != at:
                    block, at = _Block(), number[i]
                if kind[i] == 0:
                    block.add(rid[i:j], ids[i:j], labels[i:j], vectors[i:j])
                    continue
                block.close()
                rows = []
                for s in range(i, j, STRIPE):
                    e = min(s + STRIPE, j)
                    low, high = block.codes.intervals(vectors[s:e])
                    for a in range(s, e):
                        goals = [(w["place"], w["score"]) for w in wanted[a].as_py() or ()]
                        rows += [(rid[a], ids[a], *r) for r in best(block, rid[a], labels[a], vectors[a], low[a - s], high[a - s], goals)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(cols)],
                                                     [x.split()[0] for x in _FOUND.split(", ")])
    return run


def _scan(rows: DataFrame, anchors: DataFrame, blocks: int, dim: int, best: Callable) -> DataFrame:
    """``best`` of every block for every anchor."""
    shape = ["block", "kind", "rid", "vec_id", "label", "vector", "wanted"]
    dealt = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    held = rows.select(dealt.alias("block"), F.lit(0).alias("kind"), "rid", "vec_id", "label", "vector",
                       F.lit(None).cast("array<struct<place:int,score:long>>").alias("wanted"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                          "rid", "vec_id", "label", "vector", "wanted")
    stream = held.union(sent.select(shape)).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return stream.mapInArrow(_scan_task(dim, best), _FOUND)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, as (rid, vec_id, label, vector): ids, labels with
    the noise rule applied, and integer vectors; ``rid`` numbers the written rows."""
    e, vec_id = F.col("embedding"), F.col("vec_id").cast("long")
    fine = (vec_id.isNotNull() & F.col("label").isNotNull() & e.isNotNull()
            & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    label = F.col("label").cast("long")
    label = F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    rows = embeddings.where(fine).select(F.monotonically_increasing_id().alias("rid"), vec_id.alias("vec_id"), label.alias("label"),
                                         F.transform(e, lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"))
    return C.staged(rows, "vectors")


def mine(embeddings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by 100.  The positives of an
    anchor are its ``POSITIVES`` best other rows of the same label; for each, its
    negatives are the ``NEGATIVES`` best rows of another label whose score lies
    within ``LOW`` and ``HIGH`` hundredths of the positive's.  Higher scores come
    first, ties by smaller vec_id.  All rows are looked at and results are exact.

    Rows with a null vec_id, label or vector, or a null or non-finite component
    take no part.  Repeated rows are rows of their own: a copy of an anchor is an
    anchor and another row.  A shorter vector counts as ended by zeros, an empty
    one scores 0.  Other columns play no part.  Scores are 64-bit integers, so
    components are taken to stay under 2**28 / 256.  An empty table, or one
    without anchors, gives no rows.
    """
    spark = embeddings.sparkSession
    C.bounded_batches(spark)
    rows = whole_vectors(embeddings)
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim = max(64, math.ceil((known["dim"] or 0) / 64) * 64)
    blocks = max(1, math.ceil(known["n"] / block_rows))
    none = F.lit(None).cast("array<struct<place:int,score:long>>")
    anchors = rows.where(anchors_of(F.col("vec_id")))

    found = _scan(rows, anchors.withColumn("wanted", none), blocks, dim, _best_positives)
    order = Window.partitionBy("anchor_rid").orderBy(F.desc("score"), "other_id", "other_rid")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES)
    positives = C.staged(found.select("anchor_rid", "place", F.col("other_id").alias("positive_id"),
                                      F.col("score").alias("positive_score")), "positives")

    wanted = positives.groupBy(F.col("anchor_rid").alias("rid")).agg(
        F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("wanted"))
    found = _scan(rows, anchors.join(wanted, "rid"), blocks, dim, _best_negatives)
    order = Window.partitionBy("anchor_rid", "place").orderBy(F.desc("score"), "other_id", "other_rid")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return found.join(positives, ["anchor_rid", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
