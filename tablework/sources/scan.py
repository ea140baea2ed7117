"""Table scans (CSV, Parquet), dataset resolution and source registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED = ("csv", "parquet")


class UnsupportedSource(ValueError):
    pass


class DatasetNotFound(FileNotFoundError):
    pass


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Plain parquet scan: filters and projections
    written later reach the file reader (``PushedFilters``/``ReadSchema``)."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             sampling_ratio: float | None = None) -> DataFrame:
    """CSV with a header.  A caller's schema skips inference (one pass less
    over the data); otherwise types are inferred, on a sample if asked."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
        if sampling_ratio:
            reader = reader.option("samplingRatio", sampling_ratio)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def source_format(path: str) -> str:
    """Format from the file (or directory) name; anything else is refused."""
    low = path.rstrip("/").lower()
    for fmt in SUPPORTED:
        if low.endswith("." + fmt):
            return fmt
    raise UnsupportedSource(f"Neither CSV nor Parquet: {path}")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    fmt = source_format(path)
    return read_csv(spark, path) if fmt == "csv" else read_parquet(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def resolve_dataset(spark: SparkSession, data_dir: str, dataset_id: str) -> str:
    """``<id>.csv`` first, then ``<id>.parquet``; checked through the cluster
    file system so it works on any Hadoop-compatible store."""
    for fmt in SUPPORTED:
        p = f"{data_dir.rstrip('/')}/{dataset_id}.{fmt}"
        if _exists(spark, p):
            return p
    raise DatasetNotFound(f"No dataset is named {dataset_id}")


def dataset_exists(spark: SparkSession, data_dir: str, dataset_id: str) -> bool:
    try:
        resolve_dataset(spark, data_dir, dataset_id)
        return True
    except DatasetNotFound:
        return False


def load_dataset(spark: SparkSession, data_dir: str, dataset_id: str) -> DataFrame:
    return read_source(spark, resolve_dataset(spark, data_dir, dataset_id))


def register_sources(spark: SparkSession, sources: dict) -> dict:
    """``{name: path or DataFrame}`` → temp views; returns name → DataFrame."""
    out = {}
    for name, src in sources.items():
        df = src if isinstance(src, DataFrame) else read_source(spark, src)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def register_tables(spark: SparkSession, sf_dir: str, names) -> dict:
    return register_sources(spark, {n: load(spark, sf_dir, n) for n in names})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null mean the same thing here (pandas folds them).  Applied
    once, on demand: it hides the columns from parquet filter pushdown, so
    the statistics operators apply the same rule inside their aggregates
    instead of at load."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
