"""Distinct counts from stored sketches: a sketch per group is built once, and any
coarser count is a merge of sketches that reads no rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.session import written_once

#: log2 of a sketch's buckets: a relative standard error of about 0.8 % in 16 KB at most.
LG_BUCKETS = 14


def distinct_sketches(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, rows, sketch``, stored: one HyperLogLog sketch of ``column``'s
    non-null values per group (partial per task, merged in the shuffle).  A group
    without a value has a null sketch."""
    v = F.col(f"`{column}`")
    return written_once(df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(v).alias("rows"), F.hll_sketch_agg(v, LG_BUCKETS).alias("sketch")), "sketches")


def merged_distinct(sketches: DataFrame, keys: list[str], name: str = "approx_distinct") -> DataFrame:
    """``keys, rows, <name>`` of a sketch table, merged to coarser ``keys``."""
    whole = sketches.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))
    return whole.withColumn(name, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))).drop("sketch")
