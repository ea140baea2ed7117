"""Exact quantiles (linear interpolation, as pandas ``quantile`` and SQL
``quantile_cont``) by one path at any table size.

Spark's exact ``percentile`` merges one counter per distinct value in one
task.  Here, for every (column, p):

1. one aggregate for all columns: non-null count and a ``percentile_approx``
   sketch (rank error ≤ n / ``accuracy``) at ``p ± 3/accuracy`` → a value
   bracket that must hold the wanted ranks;
2. one aggregate counts the values below and inside every bracket; a bracket
   that does not hold its ranks becomes the whole column (exact, only slower);
3. one scan emits the in-bracket values, grouped by value with counts
   (combined per task), range-partitioned by (bracket, value).  Cumulative
   counts are taken per partition and shifted by what the partitions before
   hold, so no bracket is ever in one task; the driver gets the one or two
   values per bracket that were asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.operators.profile import clean_value
from tablework.session import ensure_shared_dir

DEFAULT_ACCURACY = 2000


def _clamp(x: float) -> float:
    return min(max(x, 0.0), 1.0)


class _Bracket:
    """Ranks wanted of one column, and the value range that holds them."""

    def __init__(self, col: str, place: int, n: int, p: float, lo: float, hi: float):
        pos = p * (n - 1)
        self.col, self.place, self.lo, self.hi = col, place, lo, hi
        self.first = math.floor(pos)
        self.second = min(self.first + 1, n - 1) if pos > self.first else self.first
        self.share = pos - self.first
        self.below = 0

    def inside(self, v):
        return (v >= F.lit(self.lo)) & (v <= F.lit(self.hi))


def _values_at(pairs: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """``{(cell, rank): value}`` of ``pairs`` (cell, v, cnt) in value order."""
    spark = pairs.sparkSession
    ensure_shared_dir(spark)
    rows = pairs.repartitionByRange(F.col("cell"), F.col("v")).withColumn("part", F.spark_partition_id()).checkpoint()
    sums = rows.groupBy("cell", "part").agg(F.sum("cnt").alias("all"))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("cell", "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("shift"))  # one row per bracket and partition
    upto = Window.partitionBy("cell", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("cnt").over(upto)).join(sums, ["cell", "part"])
    end = F.col("upto") + F.col("shift")
    asked = spark.createDataFrame(sorted(set(wanted)), "cell int, rank long")
    hits = rows.join(F.broadcast(asked), "cell").where((F.col("rank") < end) & (F.col("rank") >= end - F.col("cnt")))
    return {(r["cell"], r["rank"]): r["v"] for r in hits.select("cell", "rank", "v").collect()}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    accuracy: int = DEFAULT_ACCURACY, extra_aggs: list | None = None):
    """``{column: [quantile for p in probs]}`` (None for an empty column).

    ``extra_aggs`` are computed in the same first pass; when given, the
    result is ``(quantiles, first_pass_row)``."""
    out = {c: [None] * len(probs) for c in columns}
    vals = {c: clean_value(df, c).cast("double") for c in columns}
    eps = 3.0 / accuracy
    edges = sorted({_clamp(p + d) for p in probs for d in (-eps, eps)})
    at = {e: i for i, e in enumerate(edges)}
    aggs = list(extra_aggs or [])
    for i, c in enumerate(columns):
        aggs += [F.count(vals[c]).alias(f"n{i}"), F.min(vals[c]).alias(f"mn{i}"), F.max(vals[c]).alias(f"mx{i}"),
                 F.percentile_approx(vals[c], F.array(*[F.lit(e) for e in edges]), accuracy).alias(f"a{i}")]
    if not aggs:
        return out
    row = df.agg(*aggs).first()
    cells = [_Bracket(c, j, row[f"n{i}"], p, row[f"a{i}"][at[_clamp(p - eps)]], row[f"a{i}"][at[_clamp(p + eps)]])
             for i, c in enumerate(columns) if row[f"n{i}"] for j, p in enumerate(probs)]
    if cells:
        counts = df.agg(*[x for k, b in enumerate(cells) for x in (
            F.count_if(vals[b.col] < F.lit(b.lo)).alias(f"b{k}"), F.count_if(b.inside(vals[b.col])).alias(f"w{k}"))]).first()
        for k, b in enumerate(cells):
            b.below = counts[f"b{k}"]
            if not b.below <= b.first <= b.second < b.below + counts[f"w{k}"]:
                i = columns.index(b.col)
                b.lo, b.hi, b.below = row[f"mn{i}"], row[f"mx{i}"], 0
        open_cells = [(k, b) for k, b in enumerate(cells) if b.lo != b.hi]  # equal ends are the answer
        picked = {}
        if open_cells:
            tagged = [F.when(b.inside(vals[b.col]), F.struct(F.lit(k).alias("cell"), vals[b.col].alias("v"))) for k, b in open_cells]
            pairs = (df.select(F.explode(F.array_compact(F.array(*tagged))).alias("t"))
                     .groupBy(F.col("t.cell").alias("cell"), F.col("t.v").alias("v")).agg(F.count(F.lit(1)).alias("cnt")))
            picked = _values_at(pairs, [(k, r - b.below) for k, b in open_cells for r in (b.first, b.second)])
        for k, b in enumerate(cells):
            x, y = (picked[k, r - b.below] if b.lo != b.hi else b.lo for r in (b.first, b.second))
            out[b.col][b.place] = x + b.share * (y - x) if b.share else x
    return (out, row) if extra_aggs else out
