"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.sources.scan import load

DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column so both engines print the same digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(c, digits).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.round(c.cast("double"), digits).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Integer columns that can hold nulls, as doubles: pandas (and so every
    pandas-based comparison) reads a nullable integer as a float anyway."""
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in cols})


class Registry:
    """name → (query, oracle SQL or None)."""

    def __init__(self):
        self.queries = {}
        self.sql = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            if name in self.queries:
                raise KeyError(f"duplicate query name {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return deco
