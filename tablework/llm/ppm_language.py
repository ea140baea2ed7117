"""Language identification by prediction by partial matching.

Each language has a byte context tree of up to ``ORDER`` bytes with frozen
counts.  A byte costs ``-log2`` of its probability in the longest context;
a byte the context has not seen costs the escape (method C: distinct bytes
over total plus distinct) and then its price in the next shorter context,
where the bytes already seen above are excluded, down to a uniform code.  The
language with the shortest code for the whole text wins.

The alphabet is all 256 byte values.  Only contexts that were seen are held, in
sorted arrays by language, so the model is bounded by its sample, not by the
alphabet or the number of languages.  The excluded bytes of a context are just
those its one-longer context has seen, so the price of a byte after ``ORDER``
bytes is a constant of the model: a task prices each gram once and looks it up
from then on (up to ``CACHE_BYTES`` of prices).

The trees are fitted on a bounded sample: about ``TRAIN_DOCS`` labelled
documents of at most ``TRAIN_CHARS`` characters per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.llm import common as C

ORDER = 3
TRAIN_DOCS = 400
TRAIN_CHARS = 20_000
CACHE_BYTES = 24 << 20
UNKNOWN = "und"


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``ORDER`` blanks before each row; first and end position of each row."""
    shift = ORDER * np.arange(1, len(off))
    first, end = off[:-1] + shift, off[1:] + shift
    out = np.full(len(data) + ORDER * (len(off) - 1), 32, np.uint8)
    for a, b, x, y in zip(off[:-1].tolist(), off[1:].tolist(), first.tolist(), end.tolist()):
        out[x:y] = data[a:b]
    return out, first, end


def grams(sym: np.ndarray, base: int) -> np.ndarray:
    """Code of each symbol with the ``ORDER`` before it (the first ones wrap; they are padding)."""
    sym = sym.astype(np.int64)
    code = sym.copy()
    for i in range(1, ORDER + 1):
        code[i:] += sym[:-i] * base ** i
    return code


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column(0)
        for lang in langs.unique().to_pylist():
            mine = b.column(1).filter(pa.compute.equal(langs, lang))
            for _, _, data, off in C.blocks(mine):
                text, first, end = padded(data, off)
                code = grams(text, 256)
                inside = np.ones(len(code), bool)
                for i in range(ORDER):
                    inside[first - 1 - i] = False
                g, n = np.unique(code[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n)], ["lang", "g", "n"])


def _sums(key: np.ndarray, *value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of the sorted ``key`` with the sums of ``value``."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], *(np.add.reduceat(v, first) for v in value)


def _find(key: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of ``want`` in the sorted ``key``, and whether it is there."""
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return at, key[at] == want


class Tree:
    """Seen contexts of one language; codes have the newest byte lowest.

    ``grams[k]``: (codes of ``k`` bytes and the next one, counts).
    ``contexts[k]``: (codes of ``k`` bytes, total, distinct next bytes, and
    both of the context one byte shorter without what this one has seen).
    """

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.grams, self.contexts = [], []
        for k in range(ORDER + 1):
            code = gram & ((1 << 8 * (k + 1)) - 1)
            order = np.argsort(code, kind="stable")
            self.grams.append(_sums(code[order], count[order]))
        for k, (code, n) in enumerate(self.grams):
            order = np.argsort(code >> 8, kind="stable")
            code, n = code[order], n[order]
            if k:
                key, shorter = self.grams[k - 1]
                passed = shorter[_find(key, code & ((1 << 8 * k) - 1))[0]]
            else:
                passed = np.zeros(len(n))
            context, total, kinds, passed = _sums(code >> 8, n, np.ones(len(n)), passed)
            if k:
                key, all_total, all_kinds = self.contexts[k - 1][:3]
                at, _ = _find(key, context & ((1 << 8 * (k - 1)) - 1))
                self.contexts.append((context, total, kinds, all_total[at] - passed, all_kinds[at] - kinds))
            else:
                self.contexts.append((context, total, kinds, passed, passed))

    def price(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the newest byte of each gram after the ones before it."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        total = kinds = None  # what the longer context leaves of this one; None: it was not seen
        for k in range(ORDER, -1, -1):
            mine = gram[open_]
            context, all_total, all_kinds, rest_total, rest_kinds = self.contexts[k]
            at, seen = _find(context, (mine >> 8) & ((1 << 8 * k) - 1))
            t, d = np.where(seen, all_total[at], 0), np.where(seen, all_kinds[at], 0)
            if total is not None:
                t, d = np.where(np.isnan(total), t, total), np.where(np.isnan(kinds), d, kinds)
            code, n = self.grams[k]
            place, hit = _find(code, mine & ((1 << 8 * (k + 1)) - 1))
            top = t + d
            out[open_] += np.where(hit, np.log2(np.maximum(top, 1) / n[place]), np.where(d > 0, np.log2(np.maximum(top, 1) / np.maximum(d, 1)), 0))
            total, kinds = np.where(seen, rest_total[at], np.nan)[~hit], np.where(seen, rest_kinds[at], np.nan)[~hit]
            open_ = open_[~hit]
        out[open_] += np.log2(max(1, 256 - len(self.grams[0][0])))
        return out


class Model:
    """Frozen statistics: languages and their context trees over all byte values."""

    size = 256
    symbol = np.arange(256, dtype=np.uint8)

    def __init__(self, langs: list[str], gram: np.ndarray, count: np.ndarray, lang: np.ndarray):
        self.langs = langs
        self.trees = [Tree(gram[lang == i], count[lang == i]) if (lang == i).any() else None for i in range(len(langs))]
        self.forget()

    def forget(self) -> None:
        self.known, self.prices = np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "trees": self.trees}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def price(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram (distinct, sorted) in each language."""
        new = gram[~_find(self.known, gram)[1]] if len(self.known) else gram
        if len(new):
            # a language without a text to learn from codes every byte alike
            fresh = np.stack([np.full(len(new), 8.0) if t is None else t.price(new) for t in self.trees], 1).astype(np.float32)
            if (len(self.known) + len(new)) * len(self.langs) * 4 > CACHE_BYTES and len(self.known):
                self.forget()
                return self.price(gram)
            known = np.concatenate((self.known, new))
            order = np.argsort(known, kind="stable")
            self.known, self.prices = known[order], np.concatenate((self.prices, fresh))[order]
        return self.prices[_find(self.known, gram)[0]]

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        text, first, end = padded(data, off)
        if not len(text):
            return np.zeros((len(first), len(self.langs)))
        gram, at = np.unique(grams(text, 256), return_inverse=True)
        price = self.price(gram)[at]
        price = np.concatenate((price, np.zeros((1, price.shape[1]), np.float32)))
        cuts = np.stack((first, end), 1).reshape(-1)
        out = np.add.reduceat(price, cuts, axis=0, dtype=np.float64)[::2]
        out[first == end] = 0
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on labelled ``docs``; rows without label or text are ignored."""
    C.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    pick = F.lit(False)
    for name in langs:
        pick |= (F.col("lang") == name) & (F.pmod(F.xxhash64("k"), F.lit(1 << 20)) <= int(min(1, TRAIN_DOCS / sizes[name]) * (1 << 20)))
    sample = docs.where(pick).where(F.length("text") <= TRAIN_CHARS).select("lang", "text")
    found = sample.mapInArrow(_count_task, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    at = {x: i for i, x in enumerate(langs)}
    names = found.column("lang").to_pylist()
    return Model(langs, found.column("g").to_numpy(), found.column("n").to_numpy().astype(float),
                 np.array([at[x] for x in names], np.int64))


def _predict_task(model, added):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, UNKNOWN], object)
        for b in batches:
            known = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool) & bool(m.langs)
            best, score, bits_a_byte = np.full(b.num_rows, len(m.langs)), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for i, j, data, off in C.blocks(b.column(0)):
                if not m.langs:
                    break
                bits = m.bits(data, off)
                least = bits.min(1)
                best[i:j] = bits.argmin(1)
                bits_a_byte[i:j] = least / np.maximum(np.diff(off), 1)
                score[i:j] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            best[~known], score[~known] = len(m.langs), 0
            rest = [b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best], pa.string()), pa.array(score), pa.array(bits_a_byte)],
                                             [*b.schema.names[2:], *added])
    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
            added: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_bits")) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) plus the ``added`` ones:
    language, score, and bits of its code per byte of text.

    A text that is null, empty or without a letter gets ``und`` and score 0,
    as does every text if no language was learned.  The score is the share of
    the best language among all codes (0 to 1).  Columns of ``docs`` that bear
    the new names are replaced.  Equal codes go to the first language by name.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    cols = [F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter")]
    frame = docs.select(*cols, *[F.col(f"`{c}`") for c in keep])
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(added[0], T.StringType()),
                           T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.DoubleType())])
    return frame.mapInArrow(_predict_task(shared, added), schema)


def held_out(key: Column) -> Column:
    """The rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
