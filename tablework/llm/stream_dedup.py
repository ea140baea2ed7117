"""Exact deduplication with disk-backed streaming state.

Every row becomes one feed record: digest of the normalised text, identifier,
length and content locator (file and row it can be read from again).  A
streaming aggregation keyed by the digest runs over the feed in RocksDB state
without expiry: per digest it retains the identifier, length and locator of
the row that stays and the number of rows, never a text.  The state and the feed
are kept, so a later run goes on where this one ended (``state_dir``): only rows
that the feed does not hold yet, by their locators, are fed.  Texts are compared
in full only on hits: rows whose digest the state has met more than once, of this
run or earlier ones, are read again from their locators and held against the text
of the row that stays; rows that differ (a digest collision) are grouped by their
full text.

DataFrame and SQL functions only; the aggregation combines before it shuffles,
so a text that a third of all rows have is one record per task, and the joins
with the state leave splitting of skewed digests to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm.rows import by_place, located, named_back
from tablework.session import shared_path

#: Bytes of feed that a micro-batch takes at most.
BATCH_BYTES = 256 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            # no preallocated files: a store of few keys takes no more disk than they do
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            # the stores of an executor share bounded memory and close when their task has ended
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
            "spark.sql.streaming.stateStore.unloadOnCommit": "true",
            "spark.sql.streaming.metricsEnabled": "false"}


def normalised(text: Column) -> Column:
    """Without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def state_of(spark: SparkSession, feed_dir: str, feed: DataFrame, state_dir: str) -> DataFrame:
    """Run the stream over what is new in ``feed_dir``; the state: digest,
    best (length, -id, locator) and number of rows."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(feed.schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(feed_dir)
        # the longest text stays, then the smallest id; a null id comes last
        best = F.max(F.struct("chars", F.negative("doc_id").alias("id"), "at"))
        kept = stream.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
        run = (kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        state = spark.read.format("statestore").load(state_dir)
        return C.staged(state.select("key.digest", F.col("value.max").alias("best"), F.col("value.count").alias("n")), "state")
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               digest: Callable[[Column], Column] = sha256, state_dir: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 and the locator ``at``.

    Texts are equal when their normalised forms are.  Of equal texts the one
    with the most code points stays, then that with the smallest doc_id, then
    that with the greatest locator (so of repeated rows just one stays).  A
    null text equals an empty one; rows without a doc_id take part and stay
    only if no equally long one has an id.  An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = located(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    rows = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
                       F.col("__at").alias("at"))
    feed_dir = shared_path(spark, "feed") if state_dir is None else f"{state_dir.rstrip('/')}/feed"
    feed, earlier = _fed(rows, feed_dir)
    if feed.isEmpty():
        return feed.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), "at")
    state = state_of(spark, feed_dir, feed, shared_path(spark, "dedup-state") if state_dir is None else f"{state_dir.rstrip('/')}/state")

    # hits: rows of a digest that has others, held against the row that stays
    several = C.staged(state.where("n > 1").select("digest", F.col("best.at").alias("top")), "several")
    full = docs.select("doc_id", F.col("__at").alias("at"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
                       normalised(F.col("text")).alias("body"))
    if earlier is not None:
        full = full.unionByName(_read_again(earlier.join(several, "digest", "left_semi"), text_col))
    hits = full.withColumn("digest", digest(F.col("body"))).join(C.small_side(several, 200), "digest")
    first = hits.where(F.col("at") == F.col("top")).select("digest", F.col("body").alias("kept_body"))
    others = C.staged(hits.where(F.col("at") != F.col("top")).join(first, "digest")
                      .where(F.col("body") != F.col("kept_body")).select("digest", "doc_id", "at", "chars", "body"), "collided")
    if others.isEmpty():
        plain = feed.join(state, "digest")
        return _result(plain)
    # digest collisions: these rows are grouped by their full text
    tops = others.groupBy("digest", "body").agg(
        F.max(F.struct("chars", F.negative("doc_id").alias("id"), "at")).alias("best"), F.count("*").alias("n"))
    apart = others.drop("body").join(others.select("at", "body"), "at").join(tops, ["digest", "body"]).drop("body")
    apart = apart.join(feed.select("at"), "at", "left_semi")  # rows of earlier runs are compared, not returned
    fewer = others.groupBy("digest").agg(F.count("*").alias("gone"))
    rest = feed.join(others.select("at"), "at", "left_anti").join(state, "digest").join(fewer, "digest", "left")
    rest = rest.withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone")
    cols = ["doc_id", "digest", "at", "best", "n"]
    return _result(rest.select(cols).unionByName(apart.select(cols)))


def _fed(rows: DataFrame, feed_dir: str) -> tuple[DataFrame, DataFrame | None]:
    """Write the records that ``feed_dir`` does not hold yet; the records of this run,
    and those of earlier runs that are not in it (None at the first)."""
    spark = rows.sparkSession
    try:
        held = spark.read.schema(rows.schema).parquet(feed_dir)
    except AnalysisException:  # no such folder
        rows.write.parquet(feed_dir)
        return spark.read.schema(rows.schema).parquet(feed_dir), None
    rows = C.staged(rows, "records")
    earlier = C.staged(held.join(rows.select("at"), "at", "left_anti").select(*rows.columns), "earlier")
    rows.join(held.select("at"), "at", "left_anti").select(*rows.columns).write.mode("append").parquet(feed_dir)
    return rows, earlier


def _read_again(records: DataFrame, text_col: str) -> DataFrame:
    """Texts of records of earlier runs, from the files that hold them."""
    spark = records.sparkSession
    records = C.staged(records.select("doc_id", "at", "chars"), "again")
    files = [r["file"] for r in records.select("at.file").distinct().collect()]  # names of files, not rows
    if not files:
        return records.withColumn("body", F.lit(""))
    stored = located(spark.read.parquet(*files).select(F.col(f"`{text_col}`").alias("text")))
    return records.join(stored, records["at"] == stored["__at"]).select("doc_id", "at", "chars", normalised(F.col("text")).alias("body"))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.negative("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("at") == F.col("best.at")).alias("kept"), F.col("digest").alias("text_sha256"), "at")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier-ranked row has; all columns."""
    held, new = by_place(docs)
    told = duplicates(held.drop("__at"), new[id_col], new[text_col])
    gone = C.staged(told.where("NOT kept").select(F.xxhash64("at.file").alias("f"), F.col("at.row").alias("r")), "gone")
    side = C.small_side(gone, 24)
    here = (F.xxhash64(held["__at.file"]) == side["f"]) & (held["__at.row"] == side["r"])
    return named_back(held.join(side, here, "left_anti"), new)
