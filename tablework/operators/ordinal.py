"""Exact row positions without a single-partition window.

``with_row_index`` gives every row its 0-based position in a total order:

1. ``orderBy`` range-partitions and sorts the rows (a hot key spreads over
   several partitions because boundaries are sampled on all sort columns);
2. ``monotonically_increasing_id`` tags rows inside each partition in sort
   order, and the tagged frame is checkpointed to the cluster's shared
   folder, so partition contents and tags are fixed once even if an
   executor is lost and stages re-run;
3. one row per partition (count, first tag) is aggregated; its running sum
   is the partition's offset.  That table has as many rows as there are
   partitions, so its window and its broadcast are bounded by the partition
   count, not by the data.

``rank_within_groups`` builds on it: sort by (group, value), take global
positions, subtract each group's first position.  A group holding a third
of all rows is still cut across many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.session import ensure_shared_dir, join_small

_ID = "__rid"
_PART = "__part"


def with_row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    ensure_shared_dir(df.sparkSession)
    tagged = df.orderBy(*order).withColumn(_ID, F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright(F.col(_ID), 33)
    sizes = tagged.groupBy(part.alias(_PART)).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_ID).alias("__first"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = tagged.withColumn(_PART, part).join(F.broadcast(offsets), _PART)
    return (out.withColumn(name, F.col("__off") + F.col(_ID) - F.col("__first"))
               .drop(_ID, _PART, "__first", "__off"))


def rank_order(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, list[Column]]:
    """The frame tagged with a row identity, and the sort order (keys,
    value, identity) used for exact ranks.  The identity breaks ties even
    between identical rows, so a long run of equal values in a hot group is
    still cut across range partitions (only the value at a position matters)."""
    tagged = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [F.col(f"`{k}`").asc_nulls_last() for k in keys] + [value.asc_nulls_last(), F.col("__tie").asc()]
    return tagged, order


def rank_within_groups(df: DataFrame, keys: list[str], value: Column, name: str = "rank") -> DataFrame:
    """0-based position of each row inside its group, ordered by ``value``
    (nulls last); adds ``<name>`` and the group size ``group_rows``."""
    tagged, order = rank_order(df, keys, value)
    idx = with_row_index(tagged, order, "__pos").drop("__tie")
    firsts = idx.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min("__pos").alias("__gfirst"), F.count(F.lit(1)).alias("group_rows"))
    return (join_small(idx, firsts, keys, null_safe=True)
               .withColumn(name, F.col("__pos") - F.col("__gfirst"))
               .drop("__pos", "__gfirst"))


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, probs: list[float],
                      names: list[str]) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group, from exact
    positions (no per-group value map, no group in one task): ``keys..., names...``.
    Groups whose values are all null do not appear."""
    base = df.select(*[F.col(f"`{k}`") for k in keys], value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ranked = rank_within_groups(base, keys, F.col("__v"), "__r")
    n1 = F.col("group_rows") - 1
    lo = [F.floor(F.lit(p) * n1) for p in probs]
    hi = [F.ceil(F.lit(p) * n1) for p in probs]
    r = F.col("__r")
    keep = None
    for a, b in zip(lo, hi):
        c = (r == a) | (r == b)
        keep = c if keep is None else keep | c
    picked = ranked.where(keep).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.first("group_rows").alias("__n"),
        *[F.max(F.when(r == a, F.col("__v"))).alias(f"__lo{i}") for i, a in enumerate(lo)],
        *[F.max(F.when(r == b, F.col("__v"))).alias(f"__hi{i}") for i, b in enumerate(hi)])
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(p) * (F.col("__n") - 1)
        frac = pos - F.floor(pos)
        a, b = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((a + frac * (b - a)).alias(name))
    return picked.select(*[F.col(f"`{k}`") for k in keys], *out)
