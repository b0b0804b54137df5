"""Packing into sequences of a fixed length by minimum bin slack.

Documents may be cut freely: whole windows of a document are sequences of their own, and what
remains of each (its last, shorter piece) goes to a pool. A window is filled from the pool by its
longest piece and by the multiset of other lengths that comes closest to the remaining capacity,
which a subset-sum dynamic programme over bitsets finds (bit t is set if some multiset sums to t;
counts of equal lengths enter by binary splitting) and backtracking reads off. The pool holds at
most POOL pieces, so that a task's memory does not grow with its input. A window that no multiset
fills takes the beginning of another piece, and the last window of a partition, if its length is
no power of two, is cut into sequences whose lengths are, which need no padding.

Each task packs the documents it reads, without a shuffle; sequence_id is the task's partition
number above 33 bits of its own count. A null text is empty: a document of the end id alone.
Rows with null or repeated doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import mapped, slices
from tidemark.llm.encoding import ROWS, encoder, tokenizer_path

CAPACITY, POOL, END_ID = 1024, 4096, 0


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a multiset within counts whose sum is the nearest to the capacity from below."""
    reach, goal, steps = 1, 1 << capacity, []
    window = (goal << 1) - 1
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, size = min(counts[length], capacity // length), 1
        while left:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & window
            left -= size
            size *= 2
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + size
            at -= length * size
    return list(taken.items())


class Packer:
    """Pieces are (tag, start, data) with 4 bytes a token; packed windows come out as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL) -> None:
        self.capacity, self.limit = capacity, pool
        self.pool: dict[int, list[tuple]] = {}
        self.size = 0

    def add(self, tag: object, data: bytes) -> Iterator[list[tuple]]:
        n, full = len(data) // 4, self.capacity
        whole = n // full * full
        for start in range(0, whole, full):
            yield [(tag, start, data[4 * start : 4 * (start + full)])]
        if n > whole:
            self._put((tag, whole, data[4 * whole :]))
            if self.size >= self.limit:
                while self.size > self.limit // 2:
                    yield self._window()

    def _put(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]) // 4, []).append(piece)
        self.size += 1

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.size -= 1
        return piece

    def _window(self) -> list[tuple]:
        longest = max(self.pool)
        window = [self._take(longest)]
        for length, n in best_fill({k: len(v) for k, v in self.pool.items()}, self.capacity - longest):
            window += [self._take(length) for _ in range(n)]
        room = self.capacity - sum(len(p[2]) // 4 for p in window)
        if room and self.size:  # every piece left is longer than the room: one is cut
            tag, start, data = self._take(max(self.pool))
            window.append((tag, start, data[: 4 * room]))
            self._put((tag, start + room, data[4 * room :]))
        return window

    def rest(self) -> Iterator[list[tuple]]:
        while self.size:
            window = self._window()
            if self.size or sum(len(p[2]) // 4 for p in window) == self.capacity:
                yield window
            else:
                yield from self._powers(window)

    def _powers(self, window: list[tuple]) -> Iterator[list[tuple]]:
        total = sum(len(p[2]) // 4 for p in window)
        for bit in range(total.bit_length() - 1, -1, -1):
            room, out = total & 1 << bit, []
            while room:
                tag, start, data = window.pop(0)
                n = min(room, len(data) // 4)
                out.append((tag, start, data[: 4 * n]))
                if 4 * n < len(data):
                    window.insert(0, (tag, start + n, data[4 * n :]))
                room -= n
            if out:
                yield out


def pack(docs: DataFrame, path: str, drops_space: bool = False, end_id: int = END_ID, capacity: int = CAPACITY, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text", cache: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = encoder(path, drops_space, cache=cache), Packer(capacity, pool)
        sequence, end, rows = TaskContext.get().partitionId() << 33, np.array([end_id], "<u4").tobytes(), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        def windows() -> Iterator[list[tuple]]:
            for piece in slices(batches, most=ROWS, size=tokenizer.piece):
                for doc_id, data in zip(piece.column("id").to_pylist(), tokenizer.batch(piece.column("text").to_pylist()), strict=True):
                    yield from packer.add((doc_id, len(data) // 4 + 1), data + end)
            yield from packer.rest()

        for window in windows():
            offset = 0
            for (doc_id, tokens), start, data in window:
                n = len(data) // 4
                rows.append((doc_id, start, n, tokens, sequence, offset, data))
                offset += n
            sequence += 1
            if len(rows) >= 2048:
                yield batch()
                rows = []
        yield batch()

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(docs, apply, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
