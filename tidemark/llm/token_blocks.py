"""Token ids in files of patched frame-of-reference blocks.

Texts are encoded where they are read, and what is dealt by ranges of doc_id and sorted is their ids,
two bytes each where the vocabulary allows it; each task writes its range as segments of whole
documents. A segment is a byte string (all integers little-endian):

    magic "PFB1", documents u32, ids u64, position u64 of its first id among the ids of its part
    doc_id i64 and null flag u8 of each document, length u64 of each document
    start u64 of each block in the payload, and the payload's end
    payload: blocks of BLOCK ids (the last one filled up with its minimum):
        width u8, exceptions u8, minimum u32, BLOCK * width bits, places u8 and values u32 of the exceptions

A block stores each id less the block's minimum in `width` bits, which suffice for PERCENTILE of its
ids; the others are exceptions, whose low bits are zero and whose difference stands in the list.

The ranges' bounds are quantiles of all doc_ids, so that the dealing needs no pass over the texts.

Segments are rows of a Parquet table in the shared folder (Spark's commit protocol makes retried
tasks safe, and any store that Spark can write will do), with part and seq giving their order.
A null doc_id counts as the smallest LONG; a null text is empty; rows with the same doc_id follow each other in
the order of their texts' XXH64; repeated rows are encoded one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import mapped, slices, written
from tidemark.llm.encoding import ROWS, encoder, tokenizer_path

BLOCK, PERCENTILE, SEGMENT_IDS, END_ID = 256, 90, 1 << 16, 1
#: Blocks that are packed or unpacked at a time, however long a text is.
STEP = 512
_HEAD = struct.Struct("<4sIQQ")
_BLOCK = struct.Struct("<BBI")
_LEAST = -(1 << 63)
_WIDTHS = np.array([int(v).bit_length() for v in range(1 << 16)], np.uint8)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> 16
    return np.where(high > 0, _WIDTHS[high] + 16, _WIDTHS[x & 0xFFFF]).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values under 2**width as rows of BLOCK * width / 8 bytes: of each 64 values `width` words, the first value in the lowest bits."""
    if width in (8, 16, 32):  # whole bytes stand there as they are
        return values.astype(f"<u{width // 8}").view(np.uint8).reshape(len(values), -1)
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(64):
        word, low = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(low)
        if low + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - low)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(rows).view(f"<u{width // 8}").astype(np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), np.uint64)
    for k in range(64):
        word, low = divmod(k * width, 64)
        lanes[k] = words[word] >> np.uint64(low)
        if low + width > 64:
            lanes[k] |= words[word + 1] << np.uint64(64 - low)
    lanes &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(lanes.T).astype(np.uint32).reshape(len(rows), BLOCK)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(block starts and the payload's end, payload) of unsigned 32-bit ids."""
    out = [b for at in range(0, len(ids), STEP * BLOCK) for b in _blocks(ids[at : at + STEP * BLOCK])]
    starts = np.zeros(len(out) + 1, np.uint64)
    starts[1:] = np.cumsum([len(b) for b in out])
    return starts, b"".join(out)


def _blocks(ids: np.ndarray) -> list[bytes]:
    count = -(-len(ids) // BLOCK)
    x = np.full(count * BLOCK, ids[(count - 1) * BLOCK :].min(), np.uint32)
    x[: len(ids)] = ids
    x = x.reshape(count, BLOCK)
    least = x.min(axis=1)
    x = x - least[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    widths = _bit_length(np.partition(x, at, axis=1)[:, at])
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        some = x[rows]
        over = (some >> np.uint32(width)) > 0 if width < 32 else np.zeros(some.shape, bool)
        packed = _pack(np.where(over, 0, some), width) if width else np.zeros((len(rows), 0), np.uint8)
        for k, row in enumerate(rows.tolist()):
            places = np.flatnonzero(over[k])
            out[row] = _BLOCK.pack(width, len(places), int(least[row])) + packed[k].tobytes() + places.astype(np.uint8).tobytes() + some[k, places].astype("<u4").tobytes()
    return out


def unpack_blocks(starts: np.ndarray, payload: bytes, n: int) -> np.ndarray:
    """The n ids of the blocks; any run of blocks can be read by its starts."""
    out = np.empty(BLOCK * (len(starts) - 1), np.uint32)
    for at in range(0, len(starts) - 1, STEP):
        some = starts[at : at + STEP + 1]
        out[BLOCK * at : BLOCK * (at + len(some) - 1)] = _unpacked(some, payload)
    return out[:n]


def _unpacked(starts: np.ndarray, payload: bytes) -> np.ndarray:
    count = len(starts) - 1
    data, at = np.frombuffer(payload, np.uint8), starts[:-1].astype(np.int64)
    widths, exceptions = data[at], data[at + 1]
    least = data[at[:, None] + np.arange(2, 6)].copy().view("<u4").reshape(-1)
    x = np.zeros((count, BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width:
            x[rows] = _unpack(data[at[rows][:, None] + np.arange(6, 6 + BLOCK * width // 8)], width)
    for row in np.flatnonzero(exceptions).tolist():
        k, start = int(exceptions[row]), int(at[row]) + 6 + BLOCK * int(widths[row]) // 8
        x[row, data[start : start + k]] = np.frombuffer(payload, "<u4", k, start + k)
    return (x + least[:, None]).reshape(-1)


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], start: int) -> bytes:
    stream = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts, payload = pack_blocks(stream)
    return b"".join(
        (
            _HEAD.pack(b"PFB1", len(doc_ids), len(stream), start),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            payload,
        )
    )


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc_ids, lengths, ids, position of the first id in the part)."""
    magic, docs, n, start = _HEAD.unpack_from(data)
    if magic != b"PFB1":
        raise ValueError("not a segment of token blocks")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    blocks = -(-n // BLOCK)
    starts = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs)
    ids = unpack_blocks(starts, data[at + 17 * docs + 8 * (blocks + 1) :], n)
    return [None if gone else i for i, gone in zip(doc_ids, null, strict=True)], lengths, ids, start


def part_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """The keys at which each part but the first begins: quantiles over all rows, of which only the keys are read. A key that would fill several parts stands there as often."""
    if parts < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], F.lit(max(10_000, 20 * parts)))).first()[0]
    return np.array(found or [], np.int64)


def part_of(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each row: parts are in the order of (key, hash), and a key that stands in the bounds several times is dealt among its parts by ranges of the hash."""
    first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    share = (hashes.astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 2**-53)
    many = last - first
    return np.where(many > 1, first + 1 + (share * many).astype(np.int64).clip(0, many - 1), last).astype(np.int32)


def write_tokens(docs: DataFrame, path: str, drops_space: bool = True, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of segments (part, seq, n_ids, segment), written to the shared folder."""

    kind = "<u2" if encoder(path, drops_space).highest < 1 << 16 and end_id < 1 << 16 else "<u4"
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("key"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = part_bounds(docs, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = encoder(path, drops_space), np.array([end_id], "<u4").tobytes()
        for piece in slices(batches, most=ROWS, size=tokenizer.piece):
            ids = [np.frombuffer(data + end, "<u4").astype(kind).tobytes() for data in tokenizer.batch(piece.column("text").to_pylist())]
            part = part_of(piece.column("key").to_numpy(), piece.column("h").to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(piece.column(c) for c in ("key", "id", "h")), pa.array(ids, pa.binary())], names=["part", "key", "id", "h", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([size], pa.int64()), "segment": pa.array([write_segment(doc_ids, ids, start)], pa.binary())})

        for piece in slices(batches, "ids"):
            for doc_id, data in zip(piece.column("id").to_pylist(), piece.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(data, kind).astype("<u4"))
                size += len(ids[-1])
                if size >= SEGMENT_IDS:
                    yield segment()
                    seq, start, size = seq + 1, start + size, 0
                    doc_ids, ids = [], []
        if doc_ids:
            yield segment()

    encoded = mapped(docs, encode, "part int, key long, id long, h long, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "h").select("id", "ids")
    return written(mapped(dealt, store, "part int, seq int, n_ids long, segment binary"), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the segments: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    before, total = {}, 0
    # a number for each part, of which there are as many as tasks wrote
    for row in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[row["part"]] = total
        total += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc_ids, lengths, ids, start = read_segment(batch.column("segment")[at].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + (start + before[batch.column("part")[at].as_py()])), pa.array(lengths), pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return mapped(segments.select("part", "segment"), decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
    return read_tokens(segments).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_token_blocks": op3_token_blocks}
