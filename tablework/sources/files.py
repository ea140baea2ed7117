"""File-level sources and sinks: result frames, dataset ingest, catalogue,
fingerprints, task lists and run traces."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.session import shared_path
from tablework.sources import ledger
from tablework.sources.scan import SUPPORTED, UnsupportedSource, read_source, source_format

# Result frames are named by the first 12 hex digits of the
# SHA-1 of the query text.
RESULT_HASH_CHARS = 12
# Bytes of a file that a task holds at once while hashing it.
CHUNK_BYTES = 8 << 20


def result_name(query: str) -> str:
    return "result_" + hashlib.sha1(query.encode("utf-8")).hexdigest()[:RESULT_HASH_CHARS]


def _result_root(spark: SparkSession, query: str, out_root: str | None) -> str:
    root = out_root or shared_path(spark, "results")
    return f"{root.rstrip('/')}/frames/{result_name(query)}"


def save_result(df: DataFrame, query: str, out_root: str | None = None) -> str:
    """Commit a result frame to ``<out_root>/frames/result_<hash>`` (Parquet) and
    return the folder of this version; the default root is the cluster's shared
    folder.  Until the commit readers see the result before it."""
    return ledger.write(df, _result_root(df.sparkSession, query, out_root))


def read_result(spark: SparkSession, query: str, out_root: str) -> DataFrame | None:
    """The newest committed result of a query, if there is one."""
    folder = ledger.current(spark, _result_root(spark, query, out_root))
    return None if folder is None else spark.read.parquet(folder)


def save_prepared(df: DataFrame, run_dir: str) -> str:
    """Commit the prepared table of a run; returns the folder of this version."""
    return ledger.write(df, f"{run_dir.rstrip('/')}/prepared_data")


def read_prepared(spark: SparkSession, run_dir: str) -> DataFrame | None:
    folder = ledger.current(spark, f"{run_dir.rstrip('/')}/prepared_data")
    return None if folder is None else spark.read.parquet(folder)


def ingest_dataset(spark: SparkSession, src_path: str, data_dir: str, dataset_id: str | None = None) -> str:
    """Store an uploaded CSV or Parquet file as ``<data_dir>/<id>.parquet``
    (id = file stem); other formats are refused before any read."""
    fmt = source_format(src_path)
    if fmt not in SUPPORTED:
        raise UnsupportedSource(f"Neither CSV nor Parquet: {src_path}")
    stem = dataset_id or src_path.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    out = f"{data_dir.rstrip('/')}/{stem}.parquet"
    read_source(spark, src_path).write.mode("overwrite").parquet(out)
    return out


def file_listing(spark: SparkSession, data_dir: str, pattern: str = "*.{csv,parquet}") -> DataFrame:
    """``path, dataset, length, modificationTime`` of the files of the datasets
    in ``data_dir``.  A dataset is a file or a directory there, named by
    ``dataset``; files whose names say they are hidden are left out.  The
    ``content`` column is never selected, so no file body is read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(data_dir).select("path", "length", "modificationTime"))
    inside = F.substring_index(F.col("path"), "/" + data_dir.rstrip("/").split("/")[-1] + "/", -1)
    listed = found.withColumn("inside", inside).withColumn("dataset", F.substring_index("inside", "/", 1))
    return listed.where(~F.col("inside").rlike(r"(^|/)[._]")).select("path", "dataset", "length", "modificationTime")


def _open(path: str):
    """(file system, path) in a task."""
    import pyarrow.fs as pafs
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


#: Bytes at the beginning of a CSV file that hold its header.
HEAD_BYTES = 1 << 20


def _file_columns(batches):
    """Task: (path) to (path, place, column), from a Parquet footer or a CSV header; unreadable files give nothing."""
    import csv
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    for b in batches:
        rows = []
        for name in b.column(0).to_pylist():
            fs, path = _open(name)
            try:
                if name.endswith(".parquet"):
                    with fs.open_input_file(path) as f:
                        columns = pq.read_schema(f).names
                else:
                    with fs.open_input_stream(path) as f:
                        head = f.read(HEAD_BYTES).decode("utf-8", "replace")
                    columns = next(csv.reader(io.StringIO(head)), [])
            except (pa.ArrowException, OSError, csv.Error):
                continue
            rows += [(name, i, c) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.string())], ["path", "place", "column"])


def dataset_catalog(spark: SparkSession, data_dir: str) -> DataFrame:
    """``dataset_id, filename, rows (null), columns, size_bytes, upload_time``
    of every dataset, file or directory.

    One listing gives sizes and times; footers and headers are read in tasks, one
    file each, and merged per dataset on the cluster: a column stands where the
    first file that has it has it.  A dataset none of whose files can be read
    has no columns."""
    files = file_listing(spark, data_dir)
    files = files.withColumnRenamed("dataset", "filename").where(F.col("filename").rlike(r"\.(csv|parquet)$"))
    found = files.groupBy("filename").agg(
        F.sum("length").alias("size_bytes"), (F.unix_micros(F.max("modificationTime")) / 1e6).alias("upload_time"))
    read = files.select("path").repartition("path").mapInArrow(_file_columns, "path string, place int, column string")
    columns = files.select("path", "filename").join(read, "path").groupBy("filename", "column").agg(F.min(F.struct("path", "place")).alias("at"))
    columns = columns.groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "column"))), lambda x: x["column"]).alias("columns"))
    return (found.join(columns, "filename", "left")
                 .select(F.regexp_extract("filename", r"^(.*)\.[^.]+$", 1).alias("dataset_id"),
                         "filename", F.lit(None).cast("long").alias("rows"), "columns",
                         "size_bytes", "upload_time"))


#: A sampled schema reads at most so many ranges of at most so many bytes.
SAMPLE_RANGES, SAMPLE_BYTES = 16, 256 << 10
# Kinds of text in a CSV file, each with its form; any other text is ``text``.
KINDS = (("null", r""), ("bool", r"true|false|TRUE|FALSE|True|False"), ("int", r"[+-]?\d{1,18}"),
         ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(NaN|Infinity)"), ("date", r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?"))


def _sample_kinds(batches):
    """Task: (path, offset, rows) to (place, column, kind, rows): the kinds of the values
    in whole lines from an offset on; the rows of a range stand beside one kind of a column."""
    import csv
    import io
    import re

    import pyarrow as pa

    forms = [(k, re.compile(f)) for k, f in KINDS]
    for b in batches:
        found = []
        for path, offset, most in zip(*(c.to_pylist() for c in b.columns)):
            fs, path = _open(path)
            with fs.open_input_file(path) as f:
                names = next(csv.reader(io.StringIO(f.read(HEAD_BYTES).decode("utf-8", "replace"))), [])
                f.seek(offset)
                body = f.read(SAMPLE_BYTES)
                whole = f.tell() == f.size()
            lines = body.split(b"\n")[1:]  # the header, or a line that began before
            lines = lines if whole else lines[:-1]
            rows = [r for r in csv.reader(io.StringIO(b"\n".join(lines).decode("utf-8", "replace"))) if len(r) == len(names)][:most]
            for i, name in enumerate(names):
                kinds = {next((k for k, form in forms if form.fullmatch(r[i])), "text") for r in rows}
                found += [(i, name, kind, 0 if k else len(rows)) for k, kind in enumerate(sorted(kinds or {"null"}))]
        cols = list(zip(*found)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                                         ["place", "column", "kind", "rows"])


def sampled_schema(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """``ordinal, column, type, rows_read`` of a CSV file or directory, from at most
    ``rows`` rows: tasks read a few byte ranges, spread over files and offsets, and
    the kinds they meet are merged (null is below all; int is below double; any
    other two are text).  A row that a line break in quotes cuts is left out."""
    files = file_listing(spark, path, "*.csv").where("length > 0").orderBy("path").limit(SAMPLE_RANGES)
    each = F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_RANGES) / files.agg(F.count(F.lit(1))).scalar())).cast("int")
    spread = files.select("path", F.explode(F.sequence(F.lit(0), each - 1)).alias("k"), "length", each.alias("n"))
    spread = spread.select("path", F.floor(F.col("k") * F.col("length") / F.col("n")).alias("offset"), F.lit(max(1, rows // SAMPLE_RANGES)).alias("rows"))
    met = spread.repartition("path", "offset").mapInArrow(_sample_kinds, "place int, column string, kind string, rows long")
    one = met.where("kind <> 'null'").groupBy("place", "column").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    kinds = F.col("kinds")
    kind = (F.when(kinds.isNull(), "null").when(F.size(kinds) == 1, kinds[0])
            .when(kinds == F.array(F.lit("double"), F.lit("int")), "double").otherwise("text"))
    read = met.groupBy("place", "column").agg(F.sum("rows").alias("rows_read"))
    return read.join(one, ["place", "column"], "left").select(F.col("place").alias("ordinal"), "column", kind.alias("type"), "rows_read")


def _hash_files(batches):
    """Task: SHA-256 of each file, read in chunks."""
    import pyarrow as pa

    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            fs, path = _open(path)
            digest = hashlib.sha256()
            with fs.open_input_stream(path) as f:
                while chunk := f.read(CHUNK_BYTES):
                    digest.update(chunk)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(out, pa.string())],
                                         ["dataset", "filename", "size_bytes", "sha256"])


def fingerprint_files(spark: SparkSession, data_dir: str, pattern: str = "*.parquet") -> DataFrame:
    """``dataset, filename, size_bytes, sha256`` (64 hex) of every file of the
    datasets in ``data_dir``; a task streams a file, of any size, in chunks."""
    files = file_listing(spark, data_dir, pattern).select(
        F.col("path"), "dataset", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"))
    return files.repartition(F.col("path")).mapInArrow(_hash_files, "dataset string, filename string, size_bytes long, sha256 string")


#: Bytes of a leaf of the digest tree.
LEAF_BYTES = 32 << 20


def _hash_ranges(leaf: int):
    """Task: (path, number) to (path, number, SHA-256 of that range of the file)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = _open(path)
                with fs.open_input_file(path) as f:
                    f.seek(number * leaf)
                    out.append(hashlib.sha256(f.read(leaf)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["path", "number", "leaf"])
    return run


def fingerprint_trees(spark: SparkSession, data_dir: str, pattern: str = "*.parquet", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``dataset, filename, size_bytes, leaves, tree_sha256`` of every file: the
    SHA-256 of the hex digests, in order, of its ranges of ``leaf_bytes``.  Each
    range is a row of its own, so one large file is the work of many tasks.  Empty
    files are not listed."""
    files = file_listing(spark, data_dir, pattern).withColumnRenamed("length", "size_bytes")
    last = F.greatest(F.ceil(F.col("size_bytes") / leaf_bytes).cast("int") - 1, F.lit(0))
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), last)).alias("number"))
    leaves = ranges.repartition("path", "number").mapInArrow(_hash_ranges(leaf_bytes), "path string, number int, leaf string")
    trees = leaves.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("number", "leaf"))).alias("all"))
    trees = trees.select("path", F.size("all").alias("leaves"), F.sha2(F.concat_ws("", "all.leaf"), 256).alias("tree_sha256"))
    return files.join(trees, "path").select("dataset", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "size_bytes", "leaves", "tree_sha256")


def fingerprint_rows(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and, per half of the MD5 of a
    row, the sum of these 64-bit halves (as 38-digit decimals, so repeated rows do
    not cancel out as they would with XOR).  One aggregate pass.

    A row is its columns as text, each after a ``|`` but the first, nulls as
    ``null``: any SQL engine that writes the values alike gives the same sums."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns]
    md5 = F.md5(F.encode(F.concat_ws("|", *said), "UTF-8"))
    halves = [F.sum(F.conv(F.substring(md5, at, 16), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17)]
    return df.agg(F.count(F.lit(1)).alias("rows"), halves[0].alias("high_sum"), halves[1].alias("low_sum"))


TASK_SCHEMA = "id bigint, dataset_id string, question string, assertions array<string>"

STEP_FIELDS = ("id int, action string, notes string, operations array<string>, group_by array<string>, "
               "metrics array<string>, type string, x string, y string, outfile string, prompts array<string>")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task list: JSON lines with a fixed schema."""
    return spark.read.schema(TASK_SCHEMA).json(path)


def trace_schema() -> str:
    step = ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in STEP_FIELDS.split(", ")))
    return (
        "run_id string, question string, dataset_id string, start_time double, end_time double, "
        f"status string, plan struct<steps: array<struct<{step}>>, success_criteria: array<string>>, "
        "steps array<struct<step_id: int, action: string, error: string, timestamp: double, "
        "result: struct<rows: bigint, columns: string, query: string, group_by: array<string>, "
        "metrics: array<string>, chart_type: string, outfile: string, "
        "computed_values: struct<result_count: bigint>>>>")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Indented JSON, one file per run, read with a fixed schema; or the trace table
    that ``append_trace`` keeps, each run once."""
    if ledger.is_ledger(spark, path):
        return ledger.latest_by_key(spark, path, trace_schema(), "run_id")
    return spark.read.schema(trace_schema()).option("multiLine", True).json(path)


def steps_of_traces(traces: DataFrame) -> DataFrame:
    """Flat ``steps`` table (one row per step) from nested traces."""
    s = traces.select("run_id", F.explode("steps").alias("s"))
    return s.select("run_id", F.col("s.step_id").alias("step_id"), F.col("s.action").alias("action"),
                    F.coalesce(F.col("s.result.group_by"), F.array().cast("array<string>")).alias("group_by"),
                    F.coalesce(F.col("s.result.metrics"), F.array().cast("array<string>")).alias("metrics"),
                    F.col("s.result.chart_type").alias("chart_type"),
                    F.coalesce("s.result.computed_values.result_count", "s.result.rows").alias("result_count"),
                    F.col("s.result.query").alias("query"),
                    F.coalesce(F.from_json("s.result.columns", "array<string>"), F.array().cast("array<string>")).alias("columns"))


def append_trace(df: DataFrame, path: str) -> None:
    """Add run traces to a trace table (JSON lines), never rewriting it.  Runs are
    keyed by ``run_id``: one that is appended again takes the place of itself."""
    ledger.write(df, path, "json")
