"""Sum-of-squares online packing of tokenised documents into windows.

A packer keeps a level array: how many open windows are filled to each level.
A document goes to the level (or a new window) that makes the sum of the
squared counts of partially filled windows smallest, which keeps windows of
every fill at hand, so most close exactly full.  Whole windows of a document
longer than one are cut off first.

Each task packs the documents of its partition as they come and hands a window
on as soon as it is full; memory is bounded by ``MAX_OPEN`` windows.  Beyond
them, and at the end of the partition, open windows are poured together,
cutting documents at window ends; the last fill is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C

WINDOW = 2048
END_ID = 1
MAX_OPEN = 2048
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


class Tokens:
    """Ids of texts under a byte-level BPE vocabulary in rank form (the ids are
    those of the vocabulary's JSON form; ``special`` has the strings that are
    one id wherever they stand)."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special).encode

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text, allowed_special="all"), "<u4")


def special_ids(json_path: str) -> dict[str, int]:
    """The added strings of a vocabulary's JSON form with their ids."""
    with open(json_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class LevelPacker:
    """Online packer of one task; ``take`` and ``finish`` yield full windows,
    lists of (tag, start, ids)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)  # counts of open windows by fill
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def take(self, tag, ids: np.ndarray) -> Iterator[list]:
        at, w = 0, self.window
        while len(ids) - at >= w:
            yield [(tag, at, ids[at:at + w])]
            at += w
        if at < len(ids):
            yield from self._place((tag, at, ids[at:]))

    def best_level(self, size: int) -> int:
        """Fill level to put ``size`` tokens on; 0 is a new window."""
        n, w = self.levels, self.window
        fits = np.flatnonzero(n[1:w - size + 1]) + 1
        best, at = 2 * n[size] + 1, 0
        if len(fits):
            change = 2 * n[fits + size] + 1 - (2 * n[fits] - 1)
            change[fits + size == w] -= 1  # a full window is no longer counted
            i = len(fits) - 1 - int(np.argmin(change[::-1]))  # the fullest of equals
            if change[i] <= best:
                at = int(fits[i])
        return at

    def _place(self, piece) -> Iterator[list]:
        size = len(piece[2])
        at = self.best_level(size)
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if at + size == self.window:
            yield window
            return
        self.open.setdefault(at + size, []).append(window)
        self.levels[at + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self._pour(last=False)

    def _pour(self, last: bool) -> Iterator[list]:
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        total = sum(len(p[2]) for p in pieces)
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        if last:  # binary digits of the rest: powers of two are not padded
            sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        elif rest:
            sizes.append(rest)
        queue = iter(pieces)
        held = None
        for size in sizes:
            window, room = [], size
            while room:
                tag, start, ids = held or next(queue)
                window.append((tag, start, ids[:room]))
                held = (tag, start + room, ids[room:]) if len(ids) > room else None
                room -= len(window[-1][2])
            if size == self.window or last:
                yield window
            else:
                self.open[size] = [window]
                self.levels[size] = self.n_open = 1

    def finish(self) -> Iterator[list]:
        yield from self._pour(last=True)


def _pack_task(ranks_path: str, pattern: str, special: dict[str, int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, packer = Tokens(ranks_path, pattern, special), LevelPacker(window)
        end = np.array([END_ID], "<u4")
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def put(window):
            nonlocal number
            at, whole = 0, sum(len(p[2]) for p in window)
            for (doc, n), start, ids in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, number, at, whole))
                at += len(ids)
            number += 1

        def out():
            cols = list(zip(*rows)) or [()] * 8
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
            rows.clear()
            return batch

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate((tokens.ids(text or ""), end))
                for full in packer.take((doc, len(ids)), ids):
                    put(full)
                if len(rows) > 20_000:
                    yield out()
        for full in packer.finish():
            put(full)
        yield out()
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         ranks_path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_length.

    A document is its ids and a final ``END_ID``; null or empty text is the
    end id alone.  Rows with a null or repeated doc_id are packed as documents
    of their own.  Every id lies in one piece; a sequence has ``window``
    tokens or a power of two of them.  An empty table gives no rows.
    """
    C.bounded_batches(docs.sparkSession)
    if ranks_path is None:
        import public_tokenizers as P
        ranks_path, pattern, special = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special_ids(P.path("byte_bpe_50k.json"))
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(_pack_task(ranks_path, pattern, special or {}, window), SCHEMA)
