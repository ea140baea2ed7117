"""Spark session and shared-folder helpers.

All work runs in one SparkSession. Settings favour large inputs: adaptive
execution re-plans joins and shuffle sizes at run time, skewed join partitions
are split, and scan splits are sized so one task reads a bounded slice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Fixed settings for every session this package builds.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files of frames that are gone are deleted by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "tablework",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` is only given in tests and benches; on a cluster the launcher
    sets it.  ``shuffle_partitions`` should follow the cluster's core count
    (AQE then coalesces small ones).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_shared_dir(spark)
    return spark


def ensure_shared_dir(spark: SparkSession) -> str:
    """Return the cluster's shared folder (``spark.checkpoint.dir``).

    The cluster names it.  Our own is picked only on a local master, where
    the driver's disk is every task's disk; elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tablework-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared folder, for written tables and sinks."""
    base = ensure_shared_dir(spark).rstrip("/")
    return "/".join([base, "tablework", *parts, uuid.uuid4().hex[:12]])


def written_once(df, name: str):
    """``df`` written as Parquet to the shared folder and read back: for a
    small result that several frames derive from."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big, small, on, how: str = "inner", null_safe: bool = False):
    """Join ``small`` to ``big``.  The small side is checkpointed to the shared
    folder first, so it is computed once and its size in bytes is known; the
    planner broadcasts it below its threshold, else it is a shuffle join whose
    skewed partitions AQE splits."""
    from pyspark.sql import functions as F
    ensure_shared_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    side = small
    if not null_safe:
        return big.join(side, on=on, how=how)
    # keys compared with <=>, so null keys find their group too
    b, s = big.alias("__big"), side.alias("__small")
    cond = [F.col(f"__big.`{k}`").eqNullSafe(F.col(f"__small.`{k}`")) for k in on]
    rest = [c for c in small.columns if c not in on]
    return b.join(s, on=cond, how=how).select(*[F.col(f"__big.`{c}`") for c in big.columns],
                                              *[F.col(f"__small.`{c}`") for c in rest])
