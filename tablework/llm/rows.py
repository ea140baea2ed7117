"""Rows told apart by where they are stored.

A repeated or missing id does not name a row; the file that holds it and its place
there do.  Frames that come straight from Parquet files have both as metadata;
any other is written to the shared folder first.  Columns are renamed by place
while helper columns are beside them, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm import common as C


def _at(docs: DataFrame) -> Column:
    meta = docs.metadataColumn("_metadata")  # also where a column bears this name
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__at``: file and row index of each row."""
    try:
        return docs.select("*", _at(docs).alias("__at"))
    except AnalysisException:
        docs = C.staged(docs, "docs")
        return docs.select("*", _at(docs).alias("__at"))


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns as ``c0``, ``c1``, ... and a column ``__at``; the new name of each."""
    new = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return located(docs.select(*[F.col(f"`{old}`").alias(c) for old, c in new.items()])), new


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``by_place`` with a column ``__id``: a number of its own for every row, from
    the number of its file (fewer than 2**23) and its place there (below 2**40)."""
    held, new = by_place(docs)
    files = held.select(F.col("__at.file").alias("__file")).distinct()
    files = C.staged(files.withColumn("__n", F.row_number().over(Window.orderBy("__file"))), "files")  # a row per file
    side = C.small_side(files, 400)
    held = held.join(side, held["__at.file"] == side["__file"])
    return held.withColumn("__id", F.shiftleft(F.col("__n").cast("long"), 40) + F.col("__at.row")).drop("__file", "__n"), new


def named_back(held: DataFrame, new: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` again, under their own names."""
    return held.select(*[F.col(c).alias(old) for old, c in new.items()])


def without(held: DataFrame, new: dict[str, str], gone: DataFrame) -> DataFrame:
    """The rows of ``numbered`` docs whose ``__id`` is not in ``gone`` (staged; a column ``id``)."""
    side = C.small_side(gone, 16)
    return named_back(held.join(side, held["__id"] == side["id"], "left_anti"), new)
