import random
import zlib
from array import array
from functools import cache
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, documents
from tidemark.llm import encoding, packing, token_blocks
from tidemark.llm.encoding import encoder, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
TEXTS = ["é́ ſ K <|endoftext|>  x\r\n\x1c ▁ 漢字 😀", "  a  b \n\n c  ", " \n ", "ab c ", "don't, we'll  O'Neil's\n\nx ", " ́x a ́̕ ΑΣ Σ. İ ŉ", "x" * 300 + " y " + "z" * 100, None, "", "a \n b", "a\tb  c", "ab  \n"]
TEXTS += ["a<|endoftext|>b <|endoftext|>", "<|startoftext|> x<|STARTOFTEXT|>", "<|endoftext|><|endoftext|>", "<|endoftext |> <|endoftext", "a \n\n  b  ", "a  b\n c \nd", "a\0b  c", "  a", "\n\n\n", "a. b.. c., d .", "a  "]


@cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(path, text, end):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path,drops", [(WORD, True), (BYTE, False)])
def test_units_equal_whole_texts(spark, sf_dir, path, drops):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = list(encoder(path, drops).batch(texts))
    assert found == [array("I", e.ids).tobytes() for e in tokenizer(path).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_generations_of_units(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 40)
    own, rng = encoding.UnitEncoder(BYTE, False), random.Random(5)
    for _ in range(20):
        texts = [" ".join(rng.choice(["a", "bee", "sea.", "dee,", f"w{rng.randint(0, 999)}."]) for _ in range(30)) for _ in range(8)]
        assert list(own.batch(texts)) == [array("I", tokenizer(BYTE).encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        assert len(own.young) < 20 + 30 * 8 and len(own.elder) < 20 + 30 * 8


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000, 300_000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 1 << 32])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint32)
    if n > 200:
        ids[:100] = 7
        ids[150:160] = (1 << 32) - 1
    starts, payload = token_blocks.pack_blocks(ids)
    assert (token_blocks.unpack_blocks(starts, payload, n) == ids).all()
    if n > 300:  # any block on its own
        k = token_blocks.BLOCK
        one = token_blocks.unpack_blocks(starts[2:4] - starts[2], payload[int(starts[2]) : int(starts[3])], k)
        assert (one == ids[2 * k : 3 * k]).all()


@pytest.mark.parametrize("width", range(1, 33))
def test_widths(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (5, token_blocks.BLOCK), dtype=np.uint64).astype(np.uint32)
    packed = token_blocks._pack(values, width)
    assert packed.shape == (5, token_blocks.BLOCK * width // 8) and (token_blocks._unpack(packed, width) == values).all()
    bits = "".join(f"{b:08b}"[::-1] for b in packed[0].tobytes())  # the first value in the lowest bits
    assert [int(bits[i * width : (i + 1) * width][::-1], 2) for i in range(64)] == values[0, :64].tolist()


def test_outliers_are_exceptions():
    ids = np.full(token_blocks.BLOCK, 3, np.uint32)
    ids[5] = 1 << 30
    starts, payload = token_blocks.pack_blocks(ids)
    assert payload[0] == 0 and payload[1] == 1 and len(payload) == 6 + 5


def check_tokens(df):
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for r in rows:
        ids = ids_of(WORD, r[1], 1)
        want.append((r[0], start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    from pyspark.sql import functions as F

    found = token_blocks.read_tokens(token_blocks.write_tokens(df, WORD)).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want


def test_tokens_odd_rows(spark):
    check_tokens(documents(spark))
    check_tokens(clashing(documents(spark)))
    assert token_blocks.read_tokens(token_blocks.write_tokens(documents(spark, []), WORD)).collect() == []


def test_tokens_documents(spark, sf_dir):
    check_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5))


def test_parts_are_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, rng.randint(-50, 50)]), rng.randint(-(1 << 63), (1 << 63) - 1)) for _ in range(3000)]
    bounds = token_blocks.part_bounds(spark.createDataFrame(rows, "key long, h long"), 9)
    parts = token_blocks.part_of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), bounds).tolist()
    inorder = [p for _, p in sorted(zip(rows, parts))]
    assert inorder == sorted(inorder)
    assert len(set(parts)) == 9 and max(parts.count(p) for p in set(parts)) < 700
    assert token_blocks.part_bounds(spark.createDataFrame([], "key long"), 9).tolist() == []


def check_packing(df, capacity=1024, pool=4096):
    rows = packing.pack(df, BYTE, capacity=capacity, pool=pool).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
    want = {}
    for r in df.collect():
        want.setdefault(r["doc_id"], []).append(array("I", ids_of(BYTE, r["text"], 0)).tobytes())
    assert docs.keys() == want.keys()
    for k, v in want.items():
        pieces = sorted(docs[k], key=lambda r: r["start"])
        if len(v) == 1:
            assert b"".join(bytes(p["ids"]) for p in pieces) == v[0]
            assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
            assert {p["doc_tokens"] for p in pieces} == {len(v[0]) // 4}
        assert sum(p["length"] for p in pieces) == sum(map(len, v)) // 4
    waste = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(p["length"] for p in pieces)
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        assert total <= capacity
        waste += 0 if total.bit_count() == 1 else capacity - total
    assert waste == 0


def test_packing(spark, sf_dir):
    check_packing(documents(spark))
    check_packing(clashing(documents(spark)))
    check_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=256, pool=16)
    assert packing.pack(documents(spark, []), BYTE).collect() == []


def test_best_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        capacity = rng.randint(0, 90)
        counts = {x: items.count(x) for x in items}
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= capacity)
        found = packing.best_fill(counts, capacity)
        assert sum(length * n for length, n in found) == best
        assert all(n <= counts[length] for length, n in found)
