"""Reservoir samples: an exact number of rows, repeatable, in one pass.

The sample of a stratum is the ``k`` rows with the smallest seeded hashes
(bottom-k).  Such samples merge: the bottom-k of a union is the bottom-k of the
parts' bottom-k.  Every task keeps ``k`` rows per stratum before the shuffle,
these meet in ``FAN`` groups per stratum, and the groups' samples in one, so no
task gets a stratum whole or more than a fraction of all tasks' samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 32


def row_hash(by: list[str], seed: int) -> Column:
    """MD5 (lowercase hex) of the seed and the columns as text, each after a ``|``;
    a null column is ``null``.  Any SQL engine can compute it."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in by]
    return F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), *said), "UTF-8"))


def reservoir_sample(df: DataFrame, k: int, strata: list[str] | None = None, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``k`` rows of every stratum (all of them, if fewer); without ``strata``, of the table.

    A row is in if its ``row_hash`` over ``by`` (default: all columns) is among the
    ``k`` smallest of its stratum, whatever the partitions.  Rows equal in ``by``
    have one hash: which of them is in is open, how many is not.  A null stratum is
    a stratum.  ``k`` of 0 or less, or an empty table, gives no rows."""
    if k <= 0:
        return df.limit(0)
    groups = {f"__g{i}": F.col(f"`{s}`") for i, s in enumerate(strata or [])}
    rows = df.withColumns({**groups, "__h": row_hash(by or df.columns, seed), "__b": F.pmod(F.spark_partition_id(), F.lit(FAN))})

    def least(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("__h")
        return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    if groups:
        rows = least(least(rows, *groups, "__b"), *groups)
    else:  # a window needs a key: one group, held by at most FAN samples
        rows = least(least(rows, "__b").withColumn("__g", F.lit(0)), "__g").drop("__g")
    return rows.drop(*groups, "__h", "__b")
