"""SentencePiece encoding and decoding by a Viterbi search that words with a common beginning share.

A text is marked (a dummy prefix, and a mark for every blank) and cut where a mark follows another
character, which no piece spans. The distinct marked words that a worker has not met are sorted,
which lays them out as a depth-first walk of their trie, and the forward pass keeps for each prefix
of the current word its score and last piece: what two neighbours have in common is not computed
again.

The best path to a prefix is the one of the greatest sum of scores over all pieces that end there. For
a merge-trained model the path of the best sum over any pieces is not what the model's own encoder
gives, so the search runs over compatible steps: a piece may follow another only if merging their
joined text gives just these two, and begin a word only if merging its text gives it alone. Of a
prefix there is then one path, the merge encoding; where a model's scores are log-probabilities
(`merges` unset), several compete. Should no compatible piece end at a place, all pieces that do
count there. A character without a piece is a step of its own, below all pieces, and is written as
its UTF-8 bytes' pieces.

Null and empty texts have no pieces. Decoding gives the text, but for mark characters in it, which
become blanks. Rows with null or repeated doc_id are rows of their own.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import claim, mapped, slices
from tidemark.llm.encoding import tokenizer_path

MARK = "▁"
#: Words and pairs that a worker keeps, and the longest word kept.
CACHE, PAIRS, WORD_CHARS = 500_000, 1_000_000, 64
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

_models: dict[str, Pieces] = {}


class Pieces:
    """merges: the model's scores are the order of its merges."""

    def __init__(self, path: str, merges: bool = True) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = merges
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ends = {piece[k:] for piece in self.ids for k in range(len(piece))}
        self.unknown = min(self.scores.values()) - 10
        self.bytes_of = [b""] * len(ids)
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.packed = {piece: array("I", [i]).tobytes() for piece, i in self.ids.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its definition: the best-scored neighbours are merged, the leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, first: str, second: str) -> bool:
        """Whether `second` may follow `first` ("" where a word begins)."""
        key = (first, second)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(first + second) == ([first, second] if first else [second])
        return found

    def _ids(self, pieces: list[str]) -> bytes:
        packed = self.packed
        return b"".join([packed[p] if p in packed else array("I", [self.byte_ids[b] for b in p.encode()]).tobytes() for p in pieces])

    def _best(self, word: str, i: int, last: list[str], forward: list[float]) -> tuple[float, str]:
        """The best path's score to the prefix of i characters, and its last piece, where no piece is compatible: over all that end there."""
        found = []
        for start in range(i):
            piece = word[start:i]
            if piece in self.scores or start == i - 1:
                found.append((forward[start] + self.scores.get(piece, self.unknown), piece))
        return max(found, key=lambda x: x[0])

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, in one walk over them in order."""
        scores, ends, unknown, pairs, follows, merges = self.scores, self.ends, self.unknown, self.pairs, self.follows, self.merges
        out: dict[str, bytes] = {}
        before = ""
        last: list[str] = [""]  # of each prefix of the word: the last piece of its best path
        forward: list[float] = [0.0]  # and the path's score
        for word in sorted(words):
            n, common = len(word), 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            del last[common + 1 :], forward[common + 1 :]
            for i in range(common + 1, n + 1):
                # of the pieces that end here the one of the greatest sum
                best, chosen = -math.inf, ""
                for start in range(i - 1, -1, -1):
                    piece = word[start:i]
                    score = scores.get(piece)
                    if score is None:
                        if start == i - 1:
                            score = unknown
                        elif piece not in ends:
                            break
                        else:
                            continue
                    score += forward[start]
                    if score > best:
                        if merges:
                            key = (last[start], piece)
                            fits = pairs.get(key)
                            if not (follows(*key) if fits is None else fits):
                                continue
                        best, chosen = score, piece
                if not chosen:
                    best, chosen = self._best(word, i, last, forward)
                forward.append(best)
                last.append(chosen)
            pieces, i = [], n
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            out[word] = self._ids(pieces[::-1])
            before = word
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE:
            self.words = {}
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.words)
        found = self.learn([w for w in new if len(w) <= WORD_CHARS])
        self.words |= found
        long = self.learn([w for w in new if len(w) > WORD_CHARS])
        get = ChainMap(long, self.words).__getitem__ if long else self.words.__getitem__
        for words in cut:
            yield b"".join(map(get, words))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def pieces(path: str) -> Pieces:
    """The worker's model of that file."""
    claim(f"pieces {path}", lambda: _models.pop(path, None))
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary, little-endian unsigned 32-bit)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(list(model.encode(piece.column("text").to_pylist())), pa.binary())], names=["doc_id", "ids"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), apply, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of `encode`: doc_id, ids, text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for piece in slices(batches, "ids"):
            texts = [model.decode(array("I", ids)) for ids in piece.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return mapped(encoded, apply, "doc_id long, ids binary, text string")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op5_sentence_pieces": op5_sentence_pieces}
