"""Stored tables that change by commits.

Data is written under a name of its own; one empty file in ``_commits``, named by
a rising number and the data's name, then makes it visible.  Creating that file is
the only step that readers can see, so a job that dies before it leaves the old
state, and one that is run again adds a version, not half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """(file system, path) of the JVM; works on any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_ledger(spark: SparkSession, root: str) -> bool:
    fs, at = _path(spark, f"{root.rstrip('/')}/_commits")
    return fs.exists(at)


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, data folder) of the commits, oldest first."""
    root = root.rstrip("/")
    if not is_ledger(spark, root):
        return []
    fs, at = _path(spark, f"{root}/_commits")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    split = (n.partition("-") for n in names if n[:1].isdigit())
    return [(int(number), f"{root}/data/{name}") for number, _, name in split]


def stage(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write data that no reader sees yet; returns its folder."""
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    df.write.format(fmt).save(folder)
    return folder


def commit(spark: SparkSession, root: str, folder: str) -> None:
    """Make staged data the newest."""
    number = max([n for n, _ in commits(spark, root)], default=0) + 1
    fs, at = _path(spark, f"{root.rstrip('/')}/_commits/{number:012d}-{folder.rstrip('/').split('/')[-1]}")
    fs.create(at, False).close()


def write(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    folder = stage(df, root, fmt)
    commit(df.sparkSession, root, folder)
    return folder


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest commit."""
    return commits(spark, root)[-1][1] if commits(spark, root) else None


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete what the newest commit has replaced; returns how many folders went."""
    old = commits(spark, root)[:-1]
    for number, folder in old:
        for path in (f"{root.rstrip('/')}/_commits/{number:012d}-{folder.split('/')[-1]}", folder):
            fs, at = _path(spark, path)
            fs.delete(at, True)
    return len(old)


def latest_by_key(spark: SparkSession, root: str, schema: str, key: str, fmt: str = "json") -> DataFrame:
    """The rows of all commits of an appended table; of rows with one ``key`` those
    of the newest commit that has it, so what is appended again counts once."""
    done = commits(spark, root)
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).format(fmt).load([folder for _, folder in done])
    numbers = spark.createDataFrame([(folder.split("/")[-1], n) for n, folder in done], "__folder string, __commit long")
    rows = rows.withColumn("__folder", F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]+)/", 1)).join(numbers, "__folder")
    newest = rows.groupBy(F.col(key).alias("__key")).agg(F.max("__commit").alias("__newest"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__commit") == F.col("__newest"))
    return rows.join(newest, same, "left_semi").drop("__folder", "__commit")
