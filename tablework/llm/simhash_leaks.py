"""Benchmark decontamination: SimHash of item-sized windows.

A document leaks a benchmark item if one of its windows, as long as the item
in words, has a weighted shingle similarity of at least ``SIMILARITY`` to it:
over the five-word shingles, sum of weight * min(count) / sum of weight *
max(count), where a shingle that m items share weighs 1 / m.

1. Anchors: the item's shingles of lowest hash that together weigh more than
   1 - ``SIMILARITY`` of it.  Any window similar enough has one of them, so only windows
   aligned with an anchor in the document are built.
2. Each window and item has a 64-bit weighted SimHash.  Multi-index Hamming
   blocks: ``BLOCKS`` blocks, items listed under every value within ``NEAR``
   bits of theirs; two fingerprints within ``RADIUS`` bits differ by at most
   ``NEAR`` bits in some block, so the equi-join on (length, block, value)
   finds all of them.
3. The exact similarity decides.

Words are runs of letters, marks and digits, lower-cased.  A document or item
of fewer than five words is one shingle, so such an item is only found in a
document that has just its words.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm.rows import by_place, located, named_back

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BITS = 8, 8
NEAR = 2
#: Guaranteed by the blocks: in one of them at most a BLOCKS-th of the bits differ.
RADIUS = BLOCKS * (NEAR + 1) - 1

ANCHOR_BYTES, CANDIDATE_BYTES = 48, 48


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of the runs of ``SHINGLE`` words in order; fewer words are one run."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE),
                       lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    return (F.when(F.size(w) >= SHINGLE, runs).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(F.array().cast("array<bigint>")))


def _weighted(lists: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """``keys``, list of (s, tf, w) and the total weight, from rows of keys and an array ``sh``."""
    rows = lists.select(*keys, F.explode("sh").alias("s")).groupBy(*keys, "s").agg(F.count("*").alias("tf"))
    rows = rows.join(weights, "s", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "tf", "w"))).alias("bag"))
    return rows.withColumns({"fp": _simhash(), "total": F.expr("aggregate(bag, 0D, (a, x) -> a + x.w * x.tf)")})


def _simhash() -> Column:
    """Bit b of the fingerprint: the sign of the weights of the hashes, by their bit b."""
    vote = "aggregate(bag, 0D, (a, x) -> a + IF((shiftright(x.s, b) & 1L) = 1L, x.w, -x.w) * x.tf)"
    return F.expr(f"aggregate(transform(sequence(0, 63), b -> IF({vote} > 0, shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)")


def _block(fp: str, i: str) -> str:
    return f"CAST(shiftright({fp}, {i} * {BITS}) & {(1 << BITS) - 1}L AS INT)"


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, start (word
    index of the best window, the first of equals), n_words, similarity,
    hamming, and the locator ``at`` of the document's row.

    Null and empty texts and items leak nothing.  Items without an id and
    repeated items count as items of their own id; rows of ``docs`` with a
    null or repeated doc_id are told apart by their locator.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = located(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).withColumnRenamed("__at", "at")
    docs = docs.select("doc_id", "at", F.xxhash64("at.file").alias("f"), F.col("at.row").alias("r"), words(F.col("text")).alias("words"))
    bench = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), words(F.col(f"`{item_text}`")).alias("words"))
    bench = bench.where(F.size("words") > 0).distinct()
    bench = C.staged(bench.select("item_id", F.xxhash64("words").alias("item"), F.size("words").alias("n"), shingles(F.col("words")).alias("sh")), "items")
    places = bench.select("item_id", "item", "n", F.posexplode("sh").alias("j", "s"))
    weights = C.staged(places.groupBy("s").agg((1 / F.count_distinct("item_id", "item")).alias("weight")), "weights")
    keys = ["item_id", "item", "n"]
    known = C.staged(_weighted(bench, keys, weights), "known")
    # anchors: of lowest hash, until they weigh more than the similarity can miss
    anchors = known.select(*keys, F.expr(
        "filter(transform(bag, (x, i) -> struct(x.s AS s, aggregate(slice(bag, 1, i), 0D, (a, y) -> a + y.w * y.tf) AS before)), "
        f"x -> x.before <= total * {1 - SIMILARITY} + 1e-9).s").alias("s"))
    anchors = anchors.select("item_id", "item", F.explode("s").alias("s")).join(places, ["item_id", "item", "s"])
    anchors = C.small_side(C.staged(anchors.groupBy("s", "j", "n").agg(F.lit(1).alias("one")).drop("one"), "anchors"), ANCHOR_BYTES)

    seen = docs.select("f", "r", F.size("words").alias("size"), F.posexplode(shingles(F.col("words"))).alias("p", "s"))
    windows = seen.join(anchors, "s").select(
        "f", "r", "n", F.greatest(F.lit(0), F.least(F.col("p") - F.col("j"), F.col("size") - F.col("n"))).alias("start")).distinct()
    windows = C.small_side(C.staged(windows, "windows"), CANDIDATE_BYTES)
    cut = docs.join(windows, ["f", "r"]).select("doc_id", "at", "n", "start", F.expr("slice(words, start + 1, n)").alias("words"))
    cut = C.staged(cut.select("doc_id", "at", "n", "start", shingles(F.col("words")).alias("sh")), "cut")
    window = ["doc_id", "at", "n", "start"]
    prints = C.staged(_weighted(cut, window, weights), "prints")

    near = [m for m in range(1 << BITS) if bin(m).count("1") <= NEAR]
    index = known.select("n", F.expr("fp AS item_fp"), F.expr("bag AS item_bag"), F.expr("total AS item_total"), "item_id", "item")
    listed = index.select("n", "item_fp", "item_id", "item", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("blk"))
    listed = listed.select("n", "item_fp", "item_id", "item", "blk", F.explode(F.array(*[F.lit(m) for m in near])).alias("mask"))
    listed = listed.select("n", "item_fp", "item_id", "item", "blk", F.expr(f"{_block('item_fp', 'blk')} ^ mask").alias("value"))
    probes = prints.select(*window, "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("blk"))
    probes = probes.withColumn("value", F.expr(_block("fp", "blk")))
    met = probes.join(listed, ["n", "blk", "value"])
    met = met.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= RADIUS)
    met = met.select(*window, "item_id", "item", "hamming").distinct()

    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}")) for c in window]
    full = met.alias("m").join(prints.alias("w"), same).select("m.*", "w.bag", "w.total")
    full = full.alias("m").join(index.alias("i"), (F.col("m.item_id").eqNullSafe(F.col("i.item_id"))) & (F.col("m.item") == F.col("i.item")))
    meet = F.expr("aggregate(item_bag, 0D, (a, y) -> a + coalesce(aggregate(filter(bag, x -> x.s = y.s), 0D, (b, x) -> b + y.w * least(x.tf, y.tf)), 0D))")
    full = full.select(*[F.col(f"m.{c}") for c in [*window, "item_id", "hamming"]], (meet / (F.col("total") + F.col("item_total") - meet)).alias("similarity"))
    full = full.where(F.col("similarity") >= SIMILARITY - 1e-9)
    best = full.groupBy("doc_id", "at", "item_id").agg(F.max(F.struct("similarity", F.negative("start").alias("back"), F.col("n").alias("n_words"), "hamming")).alias("b"))
    return best.select("doc_id", "item_id", F.negative("b.back").alias("start"), "b.n_words", "b.similarity", "b.hamming", "at")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; all columns."""
    held, new = by_place(docs)
    bad = leaks(held.drop("__at"), items, new[id_col], new[text_col]).select(F.xxhash64("at.file").alias("f"), F.col("at.row").alias("r")).distinct()
    side = C.small_side(C.staged(bad, "leaking"), 24)
    here = (F.xxhash64(held["__at.file"]) == side["f"]) & (held["__at.row"] == side["r"])
    return named_back(held.join(side, here, "left_anti"), new)
