"""Toxicity scores from a bidirectional gated recurrent network.

A word enters as a hashed word embedding joined with the mean of the hashed
embeddings of its character trigrams, so unseen forms of a known stem are
near it.  A forward and a backward gated recurrent layer read windows of
``WINDOW`` words; attention pools their states into one logit.  Windows
overlap and cover the whole text; a document scores as its worst window.

The network is trained in numpy, on the driver, on a bounded sample: about
``TRAIN_DOCS`` labelled documents of each label, of at most ``TRAIN_CHARS``
characters.  Labels are of documents, so a step learns from the worst window
of each, and takes as many of either label.  Scoring runs in Spark tasks, all windows of a block of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C

WINDOW, STRIDE = 32, 16
THRESHOLD = 0.3
WORD_ROWS, CHAR_ROWS, EMBED = 1 << 14, 1 << 13, 8
HIDDEN, ATTEND = 8, 8
TRAIN_DOCS, TRAIN_CHARS = 1200, 4000
#: Words of fewer training texts have no embedding of their own, only their trigrams'.
LEAST_TEXTS = 4
#: Training steps, documents in one (half of each label), first learning rate.
STEPS, BATCH, RATE = 300, 32, 0.01
#: Share of the steps that learn from windows taken at random.
EXPLORE = 0.5
#: Weight decay of the embeddings, times the learning rate.
DECAY = 0.2


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


class Texts:
    """Words of a block of texts: distinct words with their trigrams, and windows over them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        h, row, start, end = C.word_hashes(data, off)
        self.rows = len(off) - 1
        _, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.hash = h[first]
        low = C._LOWER[data]
        # bytes of the distinct words, each between two zero bytes
        a, size = start[first], (end - start)[first]
        at = np.cumsum(size + 2) - (size + 2)
        raw = np.zeros(int((size + 2).sum()), np.int64)
        where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        raw[where + np.repeat(at + 1, size)] = low[where + np.repeat(a, size)]
        gram = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) > 2 else np.zeros(0, np.int64)
        # size + 2 bytes give size trigrams
        self.gram = (C.mix(gram[where + np.repeat(at, size)]) % np.uint64(CHAR_ROWS)).astype(np.int64)
        self.grams = size
        self.row_id = (self.hash % np.uint64(WORD_ROWS)).astype(np.int64)
        # windows: starts every STRIDE words until the row is covered
        n = np.bincount(row, minlength=self.rows)
        count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
        self.window_row = np.repeat(np.arange(self.rows), count)
        k = np.arange(len(self.window_row)) - np.repeat(np.cumsum(count) - count, count)
        begin = (np.cumsum(n) - n)[self.window_row] + k * STRIDE
        index = begin[:, None] + np.arange(WINDOW)
        self.mask = index < np.cumsum(n)[self.window_row][:, None]
        self.index = np.where(self.mask, index, 0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        e, h = 2 * EMBED, HIDDEN
        self.p = {"word": f(WORD_ROWS, EMBED, k=.1), "char": f(CHAR_ROWS, EMBED, k=.3),
                  "at": f(2 * h, ATTEND, k=.4), "ab": f(ATTEND, k=0), "av": f(ATTEND, k=.4), "o": f(2 * h, k=.4), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"w" + d: f(e, 3 * h, k=.4), "u" + d: f(h, 3 * h, k=.4), "c" + d: np.zeros(3 * h, np.float32)}
        self.prior = 0.0
        self.known = np.ones(WORD_ROWS, bool)  # rows of words that several training texts have

    def inputs(self, t: Texts) -> np.ndarray:
        """Embedding of each distinct word."""
        if not len(t.hash):
            return np.zeros((0, 2 * EMBED), np.float32)
        chars = np.add.reduceat(self.p["char"][t.gram], np.cumsum(t.grams) - t.grams, axis=0) / t.grams[:, None]
        word = np.where(self.known[t.row_id, None], self.p["word"][t.row_id], 0)
        return np.concatenate((word, chars), 1).astype(np.float32)

    def layer(self, d: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction; x: input parts of the gates (B, T, 3H)."""
        h3, u = HIDDEN, self.p["u" + d]
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), h3), np.float32)
        out = np.zeros((x.shape[1], len(x), h3), np.float32)
        for t in steps:
            g, m = h @ u, mask[:, t, None]
            s = _sigmoid(x[:, t, :2 * h3] + g[:, :2 * h3])
            r, z = s[:, :h3], s[:, h3:]
            n = np.tanh(x[:, t, 2 * h3:] + r * g[:, 2 * h3:])
            new = np.where(m, (1 - z) * n + z * h, h)
            if trace is not None:
                trace.append((t, h, r, z, n, g[:, 2 * h3:], m))
            h = new
            out[t] = h
        return out

    def logits(self, word: np.ndarray, index: np.ndarray, mask: np.ndarray, words: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ``index`` into the running words ``word``, whose inputs are ``words``."""
        p = self.p
        ids = word[index]
        sides, traces = [], {}
        for d in "fb":
            x = (words @ p["w" + d] + p["c" + d])[ids]
            traces[d] = [] if keep is not None else None
            sides.append(self.layer(d, x, mask, traces[d]))
        s = np.concatenate(sides, 2).transpose(1, 0, 2)
        a = np.tanh(s @ p["at"] + p["ab"])
        e = np.where(mask, a @ p["av"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        pooled = (s * e[:, :, None]).sum(1)
        if keep is not None:
            keep |= {"ids": ids, "s": s, "a": a, "e": e, "pooled": pooled, "traces": traces}
        return pooled @ p["o"] + p["b"][0]

    def gradients(self, g: np.ndarray, words: np.ndarray, keep: dict, t: Texts) -> dict:
        """Of the sum of g * logit, by every parameter."""
        p, h3, k = self.p, HIDDEN, keep
        s, a, e = k["s"], k["a"], k["e"]
        out = {"o": k["pooled"].T @ g, "b": np.array([g.sum()])}
        pooled = g[:, None] * p["o"]
        de = (s * pooled[:, None]).sum(2)
        de = e * (de - (e * de).sum(1, keepdims=True))
        out["av"] = (a * de[:, :, None]).sum((0, 1))
        da = de[:, :, None] * p["av"] * (1 - a * a)
        out["ab"] = da.sum((0, 1))
        out["at"] = np.einsum("btk,btm->km", s, da)
        ds = e[:, :, None] * pooled[:, None] + da @ p["at"].T
        dwords = np.zeros_like(words)
        for d, part in (("f", ds[:, :, :h3]), ("b", ds[:, :, h3:])):
            u, du = p["u" + d], np.zeros_like(p["u" + d])
            dx = np.zeros((*k["ids"].shape, 3 * h3), np.float32)
            dh = np.zeros((len(g), h3), np.float32)
            for step, h, r, z, n, gn, m in reversed(k["traces"][d]):
                dh = dh + part[:, step]
                live = dh * m
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate((dr, dz, dn * r), 1)
                dx[:, step] = np.concatenate((dr, dz, dn), 1)
                du += h.T @ dg
                dh = np.where(m, live * z, dh) + dg @ u.T
            flat = dx.reshape(-1, 3 * h3)
            by_word = np.zeros((len(words), 3 * h3), np.float32)
            np.add.at(by_word, k["ids"].reshape(-1), flat)
            out |= {"u" + d: du, "c" + d: flat.sum(0), "w" + d: words.T @ by_word}
            dwords += by_word @ p["w" + d].T
        used = np.unique(k["ids"])
        word, char = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(word, t.row_id[used], np.where(self.known[t.row_id[used], None], dwords[used, :EMBED], 0))
        first = np.cumsum(t.grams) - t.grams
        size = t.grams[used]
        at = np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        np.add.at(char, t.gram[at], np.repeat(dwords[used, EMBED:] / size[:, None], size, axis=0))
        return out | {"word": word, "char": char}

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 11) -> None:
        rng, moments = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        sides = [np.flatnonzero(labels == y) for y in (0, 1)]
        seen = np.zeros(WORD_ROWS, np.int64)
        for text in texts:
            seen[np.unique(Texts(*C.buffers(pa.array([text], pa.large_string()))).row_id)] += 1
        self.known = seen >= LEAST_TEXTS
        for step in range(1, STEPS + 1 if all(map(len, sides)) else 1):
            some = np.concatenate([rng.choice(x, BATCH // 2) for x in sides])
            col = pa.array([texts[i] for i in some], pa.large_string())
            t = Texts(*C.buffers(col))
            if not len(t.index):
                continue
            words = self.inputs(t)
            z = self.logits(t.word, t.index, t.mask, words)
            # the worst window of each row, and of rows of label 0 another one; at first any window,
            # so that what is learned is what many windows of label 1 share
            best = np.lexsort((-z if step > STEPS * EXPLORE else rng.random(len(z)), t.window_row))
            first = np.concatenate(([True], t.window_row[best][1:] != t.window_row[best][:-1]))
            pick = best[first]
            clean = np.flatnonzero(labels[some][t.window_row] == 0)
            if len(clean):
                pick = np.concatenate((pick, rng.choice(clean, min(len(clean), BATCH // 2), replace=False)))
            keep: dict = {}
            z = self.logits(t.word, t.index[pick], t.mask[pick], words, keep)
            y = labels[some][t.window_row[pick]]
            g = ((_sigmoid(z) - y) / len(pick)).astype(np.float32)
            rate = RATE * (1 - 0.9 * step / STEPS)
            for k, d in self.gradients(g, words, keep, t).items():
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.005 * (d * d - v)
                if k in ("word", "char"):
                    self.p[k] *= 1 - rate * DECAY
                self.p[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.995 ** step)) + 1e-8)).astype(np.float32)

    def score(self, data: np.ndarray, off: np.ndarray, most: int = 4096) -> np.ndarray:
        """Largest window probability of each row; rows without words get the prior."""
        t = Texts(data, off)
        words = self.inputs(t)
        top = np.full(t.rows, -np.inf)
        for i in range(0, len(t.index), most):
            z = self.logits(t.word, t.index[i:i + most], t.mask[i:i + most], words)
            np.maximum.at(top, t.window_row[i:i + most], z)
        return np.where(np.isneginf(top), self.prior, _sigmoid(top))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fit on rows of ``docs`` that ``labels`` (one id column, one 0/1 column)
    marks; of several labels of an id the largest counts.  With fewer than two
    labels the network stays untrained and every score is the share of label 1."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{label_col}`").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    known = C.staged(known.groupBy("k").agg(F.max("y").alias("y")), "labels")
    count = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    network = Network()
    network.prior = count.get(1, 0) / max(1, sum(count.values()))
    pick = F.lit(False)
    for y, n in count.items():
        pick |= (F.col("y") == y) & (F.pmod(F.xxhash64("k"), F.lit(1 << 20)) <= int(min(1, TRAIN_DOCS / n) * (1 << 20)))
    chosen = F.broadcast(known.where(pick))  # about TRAIN_DOCS ids of each label
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where(F.length("text") <= TRAIN_CHARS).join(chosen, "k").dropDuplicates(["k"]).toArrow().sort_by("k")
    y = rows.column("y").to_numpy().astype(np.float32)
    network.fit(rows.column("text").to_pylist(), y)
    if 0 < network.prior < 1:  # both labels were shown equally often
        network.p["b"] += np.float32(np.log(network.prior / (1 - network.prior)))
    if not len(y) or y.min() == y.max():
        network.p["o"][:] = 0
        network.p["b"][0] = np.log(max(network.prior, 1e-6) / max(1 - network.prior, 1e-6))
    return network


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for b in batches:
            out = [network.score(data, off) for _, _, data, off in C.blocks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *out]).astype(float))], ["doc_id", "score"])
    return run


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``.

    A null, empty or blank text scores the share of label 1 among the labels
    learned from.  Rows with null or repeated ids get a row each; an empty
    table gives none.  Other columns are ignored.
    """
    C.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return frame.mapInArrow(_score_task(shared), "doc_id long, score double")
