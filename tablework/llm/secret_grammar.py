"""Secret scan with inferred grammars.

Plain patterns find the base spans: assignments, access keys and long hex
runs.  Their values label credentials of each kind.  From a bounded sample of
them, and of ordinary tokens, one probabilistic automaton per kind is
inferred: the prefix tree of the sample, whose states are merged when their
symbol and end frequencies, and those of the states below, are statistically
compatible (Hoeffding bounds).  Every candidate token of every text is then
scored: the bits by which its likelihood under a credential automaton exceeds
that under the automaton of ordinary tokens.  Candidates above the margin are
spans too; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C

# Fixed values of the base rules: pattern, group whose length counts, least length.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
HEX_LEAST = 16
#: Candidates: runs of these characters, this long at least.
CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE_LEAST = 12

#: Documents that the training sample has about, values per kind, longest value.
TRAIN_DOCS, TRAIN_VALUES, TRAIN_CHARS = 20_000, 400, 200
#: Ordinary tokens are more varied.
PLAIN_VALUES = 2000
#: Confidence of the merge test; count added to every symbol of a state.
ALPHA, ADDED = 0.05, 0.1
#: Bits in favour of a credential that make a candidate a span.
MARGIN = 24.0
#: Candidates longer than this are scored one by one.
LONG = 256

_SYMBOL = np.full(256, len(CHARS), np.uint8)
_SYMBOL[list(CHARS)] = np.arange(len(CHARS))
_IS_CHAR = _SYMBOL < len(CHARS)
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def base_spans(text: str, may_have_hex: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if may_have_hex:
        out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, end and row of the maximal runs of ``mask`` within rows."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    full = off[:-1] < off[1:]
    begin, last = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    begin[off[:-1][full]] = mask[off[:-1][full]]
    last[:-1] &= ~mask[1:]
    last[off[1:][full] - 1] = mask[off[1:][full] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    return start, end, np.searchsorted(off, start, "right") - 1


class Automaton:
    """Probabilistic automaton inferred from strings by state merging.

    ``step[state, symbol]`` is the next state, ``gain[state, symbol]`` and
    ``end[state]`` are log2 probabilities.  What the sample never showed leads
    to state 0, where every symbol is as likely.
    """

    def __init__(self, strings: list[bytes]):
        size = len(CHARS)
        # prefix tree: children, visits, ends
        child, visits, ends = [{}], [0], [0]
        for s in sorted(strings):
            at = 0
            visits[0] += 1
            for x in _SYMBOL[np.frombuffer(s, np.uint8)].tolist():
                if x not in child[at]:
                    child[at][x] = len(child)
                    child.append({})
                    visits.append(0)
                    ends.append(0)
                at = child[at][x]
                visits[at] += 1
            ends[at] += 1
        bound = math.sqrt(0.5 * math.log(2 / ALPHA))
        seen = {(p, x): visits[q] for p, c in enumerate(child) for x, q in c.items()}  # passes of each arc

        def differ(f1, n1, f2, n2):
            return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

        def alike(a, b):
            todo = [(a, b)]
            done = set()
            while todo:
                a, b = todo.pop()
                if a == b or (a, b) in done:
                    continue
                done.add((a, b))
                if differ(ends[a], visits[a], ends[b], visits[b]):
                    return False
                for x in child[a].keys() | child[b].keys():
                    if differ(seen.get((a, x), 0), visits[a], seen.get((b, x), 0), visits[b]):
                        return False
                    if x in child[a] and x in child[b]:
                        todo.append((child[a][x], child[b][x]))
            return True

        def merge(a, b):
            """Fold the tree below ``b`` into ``a``."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                visits[a] += visits[b]
                ends[a] += ends[b]
                for x, q in child[b].items():
                    seen[a, x] = seen.get((a, x), 0) + seen[b, x]
                    if x in child[a]:
                        todo.append((child[a][x], q))
                    else:
                        child[a][x] = q
        red = [0]
        blue = sorted((child[0][x], 0, x) for x in child[0])
        while blue:
            q, p, x = blue.pop(0)
            for r in red:
                if alike(r, q):
                    child[p][x] = r
                    merge(r, q)
                    break
            else:
                red.append(q)
            done = set(red)
            blue = sorted((t, s, y) for s in red for y, t in child[s].items() if t not in done)
        number = {s: i + 1 for i, s in enumerate(red)}
        n = len(red) + 1
        self.step = np.zeros((n, size), np.int32)
        self.gain = np.full((n, size), -math.log2(size + 1))
        self.end = np.full(n, -math.log2(size + 1))
        self.start = 1 if strings else 0
        for s, i in number.items():
            total = max(visits[s], ends[s] + sum(seen.get((s, y), 0) for y in child[s])) + ADDED * (size + 1)
            self.gain[i] = math.log2(ADDED / total)
            self.end[i] = math.log2((ends[s] + ADDED) / total)
            for y, t in child[s].items():
                self.gain[i, y] = math.log2((seen[s, y] + ADDED) / total)
                self.step[i, y] = number[t]

    def likelihood(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log2 probability of each run of symbols."""
        out = np.zeros(len(start))
        size = end - start
        for i in np.flatnonzero(size > LONG):
            at, total = self.start, 0.0
            for x in sym[start[i]:end[i]].tolist():
                total += self.gain[at, x]
                at = self.step[at, x]
            out[i] = total + self.end[at]
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]
        first, size, state = start[order], size[order], np.full(len(order), self.start)
        total, live = np.zeros(len(order)), len(order)
        for i in range(int(size[0]) if len(order) else 0):
            live = int(np.searchsorted(-size, -i, "left"))  # those longer than i come first
            x = sym[first[:live] + i]
            total[:live] += self.gain[state[:live], x]
            state[:live] = self.step[state[:live], x]
        out[order] = total + self.end[state]
        return out


class Grammars:
    """One automaton per kind that has labelled values, and that of ordinary tokens."""

    def __init__(self, values: dict[str, list[bytes]]):
        self.kinds = []
        for i, k in enumerate(KINDS):
            if values.get(k):
                a = Automaton(values[k])
                sym = _SYMBOL[np.frombuffer(b"".join(values[k]), np.uint8)]
                size = np.array([len(v) for v in values[k]])
                end = np.cumsum(size)
                # the format is met by what is as likely, per symbol, as the unlikeliest labelled value
                self.kinds.append((i, a, (a.likelihood(sym, end - size, end) / size).min() - 1e-9))
        self.plain = Automaton(values.get("plain", []))

    def score(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits in favour of the likeliest kind whose format is met, that kind) of each candidate."""
        best, kind = np.full(len(start), -np.inf), np.zeros(len(start), np.int64)
        if not self.kinds or not len(start):
            return best, kind
        plain = self.plain.likelihood(sym, start, end)
        for i, a, floor in self.kinds:
            s = a.likelihood(sym, start, end)
            s = np.where(s >= floor * (end - start), s - plain, -np.inf)
            kind[s > best] = i
            best = np.maximum(best, s)
        return best, kind


def _scan(col: pa.Array):
    """Per block: rows, texts, bytes, offsets, base spans of each row, candidate runs."""
    texts = col.to_pylist()
    for i, j, data, off in C.blocks(col):
        hexes = set(runs(_IS_HEX[data], off, HEX_LEAST)[2].tolist())
        base = [base_spans(t or "", k in hexes) for k, t in enumerate(texts[i:j])]
        yield i, j, texts[i:j], data, off, base, runs(_IS_CHAR[data], off, CANDIDATE_LEAST)


def _outside(texts, off, base, start, end, row) -> tuple[np.ndarray, list, list]:
    """Which candidates touch no base span; their code point starts and ends."""
    keep, a, b = np.ones(len(start), bool), start - off[row], end - off[row]
    for k in np.unique(row):
        mine = np.flatnonzero(row == k) if base[k] or not texts[k].isascii() else None
        if mine is None:
            continue
        if not texts[k].isascii():
            raw = texts[k].encode()
            lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
            a[mine], b[mine] = lead[a[mine]], lead[b[mine]]
        for x in base[k]:
            keep[mine[(a[mine] < x[2]) & (b[mine] > x[0])]] = False
    return keep, a, b


def most_of(kind: str) -> int:
    return PLAIN_VALUES if kind == "plain" else TRAIN_VALUES


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, _, texts, data, off, base, (start, end, row) in _scan(batch.column(0)):
            for t, spans in zip(texts, base):
                rows += [(KINDS[k], t[c:d].encode()) for _, k, _, c, d in spans]
            keep, _, _ = _outside(texts, off, base, start, end, row)
            raw = data.tobytes()
            rows += [("plain", raw[x:y]) for x, y in zip(start[keep].tolist(), end[keep].tolist())]
        best: dict = {}
        for k, v in set(rows):
            if len(v) <= TRAIN_CHARS:
                best.setdefault(k, []).append((hashlib.sha1(v).hexdigest(), v))
        rows = [(k, h, v) for k in best for h, v in sorted(best[k])[:most_of(k)]]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["kind", "h", "v"])


def learn(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> Grammars:
    """Fit on about ``TRAIN_DOCS`` documents, at most
    ``TRAIN_VALUES`` values a kind and ``PLAIN_VALUES`` ordinary tokens (those of lowest hash)."""
    C.bounded_batches(docs.sparkSession)
    n = docs.count()
    share = min(1.0, TRAIN_DOCS / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << 20)) <= int(share * (1 << 20)))
    found = C.staged(sample.select(F.col(f"`{text_col}`")).mapInArrow(_sample_task, "kind string, h string, v binary").distinct(), "values")
    values = {k: [bytes(r["v"]) for r in found.where(F.col("kind") == k).orderBy("h").limit(most_of(k)).collect()] for k in (*KINDS, "plain")}
    return Grammars(values)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _spans_task(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = model.value
        for batch in batches:
            counts, shas, joined, added = [], [], [], []
            for _, _, texts, data, off, base, (start, end, row) in _scan(batch.column(1)):
                bits, kind = grammars.score(_SYMBOL[data], start, end)
                hit = bits >= MARGIN
                start, end, row, kind, bits = start[hit], end[hit], row[hit], kind[hit], bits[hit]
                keep, a, b = _outside(texts, off, base, start, end, row)
                more: dict = {}
                for r, x, y, k in zip(row[keep].tolist(), a[keep].tolist(), b[keep].tolist(), kind[keep].tolist()):
                    more.setdefault(r, []).append((x, k, y))
                for r, spans in enumerate(base):
                    plain = [(x, k, y) for x, k, y, _, _ in spans]
                    counts.append([sum(k == i for _, k, _ in plain) for i in range(3)])
                    shas.append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                    joined.append(_joined(sorted(plain + more.get(r, []))))
                    added.append(len(more.get(r, [])))
            counts = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, i]) for i in range(3)], pa.array(shas, pa.string()),
                 pa.array(joined, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])
    return run


def scan(docs: DataFrame, grammars: Grammars, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans by kind,
    base_sha256, spans, n_added.

    Spans are kind:start:end (of the whole match, in code points, end
    exclusive) by start, kind and end, joined by commas.  A null or empty text
    has none.  Rows with null or repeated ids get a row each; an empty table
    gives none.
    """
    C.bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(grammars)  # at most TRAIN_VALUES * TRAIN_CHARS states a kind
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return frame.mapInArrow(_spans_task(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
