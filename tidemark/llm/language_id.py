"""Language identification by interpolated Kneser-Ney character language models.

Each language's model of order ORDER is learned from a bounded sample of labelled documents: per
language the SAMPLE_DOCS rows with the smallest hash of their doc_id, whole texts of at most
SAMPLE_CHARS characters, as far as they have MODEL_VALUES / languages ** 2 characters together, which
bounds the model for any number of labels. n-grams are kept in sorted arrays of 64-bit hashes, one for
each order and common to all languages, beside a matrix of the languages' interpolated probabilities;
contexts have an array of back-off weights of their own.

Text is folded to lower case, letters and marks are symbols, and any run of other characters is one
boundary symbol. The predicted language has the lowest cross-entropy a symbol. One sampled document
in five is held back: these set the temperature that turns cross-entropies into a score, and for
each language the cross-entropy above which a prediction is marked as rejected.

Null texts and texts without a letter are `und` with score 0; so is everything if no language can
be learned. A null doc_id is not held out and never learned from; of rows with the same doc_id and
label one is learned from, the text with the smallest hash.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._shared import mapped, slices

ORDER, SAMPLE_DOCS, SAMPLE_CHARS, MODEL_VALUES = 5, 300, 200_000, 64_000_000
#: Share of a language's held-back documents whose cross-entropy the rejection threshold lets pass.
ACCEPT = 0.995
_BASE = 0x9E3779B97F4A7C15
_WINDOW = 1 << 19
_tables: list[np.ndarray] = []


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the folded symbol (0 is the boundary), and whether it is a letter."""
    if not _tables:
        fold, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
        for i in range(0x20000):  # beyond, the few letters that matter have no case
            kind = unicodedata.category(chr(i))[0]
            if kind in "LM":
                low = chr(i).lower()
                fold[i] = ord(low) if len(low) == 1 else i
                letter[i] = kind == "L"
        fold[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # ideographs
        letter[0x20000:0x323B0] = True
        _tables.extend((fold, letter))
    return _tables[0], _tables[1]


def symbols(text: str) -> np.ndarray | None:
    """The text's symbols, beginning with a boundary; None if it has no letter."""
    fold, letter = _fold()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not letter[points].any():
        return None
    out = np.concatenate([np.zeros(1, np.uint32), fold[points]])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def _hash(s: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at the given places (None: at all places from n - 1 on)."""
    out, power = None, 1
    for k in range(n):
        part = (s[n - 1 - k : len(s) - k] if at is None else s[at - k]).astype(np.uint64)
        part = (part + np.uint64(1)) * np.uint64(power)
        out = part if out is None else out + part
        power = power * _BASE & (1 << 64) - 1
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of the wanted hashes in a sorted array."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    def __init__(self, texts: dict[str, list[str]], order: int = ORDER) -> None:
        self.order, self.langs = order, sorted(texts)
        pad = np.zeros(order - 1, np.uint32)
        grams: list[list[tuple]] = []  # by language, by order: distinct (hash, context, suffix, raw count)
        for lang in self.langs:
            s = np.concatenate([x for t in texts[lang] if (found := symbols(t)) is not None for x in (pad, found)] or [pad])
            by_order = []
            for n in range(1, order + 1):
                keys, first, counts = np.unique(_hash(s, None, n), return_index=True, return_counts=True)
                ends = first + n - 1
                by_order.append((keys, _hash(s, ends - 1, n - 1) if n > 1 else np.zeros(len(keys), np.uint64), _hash(s, ends, n - 1) if n > 1 else None, counts))
            grams.append(by_order)
        self.keys, self.probs, self.contexts, self.weights = [], [], [], []
        self.scale, self.accept = 10.0, np.full(len(self.langs), np.inf)
        if not grams:
            return
        self.floor = 1.0 / (1 + len(np.unique(np.concatenate([g[0][0] for g in grams])))) if grams else 1.0
        for n in range(1, order + 1):
            keys, first = np.unique(np.concatenate([g[n - 1][0] for g in grams]), return_index=True)
            context = np.concatenate([g[n - 1][1] for g in grams])
            contexts = np.unique(context)
            context = context[first]
            if n > 1:
                suffix = np.concatenate([g[n - 1][2] for g in grams])[first]
                lower = self.probs[-1][_find(self.keys[-1], suffix)[0]]
            else:
                lower = np.full((len(keys), len(self.langs)), self.floor)
            probs, weights = np.empty((len(keys), len(self.langs))), np.ones((len(contexts), len(self.langs)))
            for k, g in enumerate(grams):
                own, own_context, _, counts = g[n - 1]
                if n < order:  # continuation counts: in how many contexts of one symbol more it occurs
                    longer, times = np.unique(g[n][2], return_counts=True)
                    at, found = _find(longer, own)
                    counts = np.where(found, times[at], 1)
                ones, twos = (counts == 1).sum(), (counts == 2).sum()
                discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
                at, _ = _find(contexts, own_context)
                total = np.bincount(at, counts, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                weights[seen, k] = discount * kinds[seen] / total[seen]
                here, found = _find(own, keys)
                count = np.where(found, np.maximum(counts[here] - discount, 0), 0) if len(own) else np.zeros(len(keys))
                over, _ = _find(contexts, context)
                probs[:, k] = np.where(total[over] > 0, count / np.maximum(total[over], 1), 0) + weights[over, k] * lower[:, k]
            self.keys.append(keys)
            self.probs.append(probs)
            self.contexts.append(contexts)
            self.weights.append(weights)
        self.probs = [p.astype(np.float32) for p in self.probs]
        self.weights = [w.astype(np.float32) for w in self.weights]

    def _log_probs(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the symbols at the given places, a column for each language."""
        here, found = _find(self.keys[0], _hash(s, at, 1))
        p = np.where(found[:, None], self.probs[0][here], self.weights[0][:1] * np.float32(self.floor))
        context = None
        for n in range(2, self.order + 1):
            here, found = _find(self.keys[n - 1], _hash(s, at, n))
            over, known = _find(self.contexts[n - 1], _hash(s, at - 1, n - 1))
            context = np.where(known[:, None], self.weights[n - 1][over], np.float32(1))
            p = np.where(found[:, None], self.probs[n - 1][here], p * context)
        return np.log(np.maximum(p, np.float32(1e-30)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy a symbol by language, number of symbols) of each text; 0 symbols if it has no letter."""
        total, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        parts: list[tuple[int, np.ndarray]] = []
        waiting = 0

        def flush() -> None:
            if not parts:
                return
            s = np.concatenate([x for _, x in parts])
            sizes = np.array([len(x) for _, x in parts])
            scored = np.ones(len(s), bool)
            starts = np.cumsum(sizes) - sizes
            for k in range(self.order - 1):
                scored[starts + k] = False
            at = np.flatnonzero(scored)
            codes, _ = pd.factorize(_hash(s, None, self.order)[at - (self.order - 1)])
            first = np.empty(codes.max() + 1, np.int64)
            first[codes[::-1]] = at[::-1]
            logs = self._log_probs(s, first)
            ends = np.searchsorted(at, starts)
            np.add.at(total, [d for d, _ in parts], np.add.reduceat(logs[codes].astype(np.float64), ends, axis=0))
            parts.clear()

        pad = np.zeros(self.order - 1, np.uint32)
        for i, text in enumerate(texts):
            s = symbols(text) if text else None
            if s is None:
                continue
            counts[i] = len(s)
            s = np.concatenate([pad, s])
            for at in range(self.order - 1, len(s), _WINDOW):  # long texts in windows that begin with the symbols before them
                piece = s[at - (self.order - 1) : at + _WINDOW]
                parts.append((i, piece))
                waiting += len(piece)
                if waiting >= _WINDOW:
                    flush()
                    waiting = 0
        flush()
        return -total / np.maximum(counts, 1)[:, None], counts

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        entropy, counts = self.entropies(texts)
        truth = np.array([self.langs.index(x) if x in self.langs else -1 for x in langs], np.int64)
        keep = (counts > 0) & (truth >= 0)
        entropy, truth = entropy[keep], truth[keep]
        if not len(truth):
            return
        grid = np.geomspace(0.5, 100, 40)
        losses = [-np.log(np.maximum(_softmax(-entropy * s)[np.arange(len(truth)), truth], 1e-9)).mean() for s in grid]
        self.scale = float(grid[int(np.argmin(losses))])
        for k in range(len(self.langs)):
            own = entropy[truth == k, k]
            if len(own):
                self.accept[k] = np.quantile(own, ACCEPT, method="higher")

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), [True] * len(texts)
        entropy, counts = self.entropies(texts)
        best = entropy.argmin(axis=1)
        rows = np.arange(len(texts))
        some = counts > 0
        score = np.where(some, _softmax(-entropy * self.scale)[rows, best], 0.0)
        own = np.where(some, entropy[rows, best], np.nan)
        rejected = ~some | (own > self.accept[best])
        return [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)], score, own, rejected.tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sampled(docs: DataFrame, docs_each: int = SAMPLE_DOCS, model_values: int = MODEL_VALUES) -> DataFrame:
    """lang, text, place (from 1 in each language) of the bounded sample; docs: id, text, lang of the rows that may be learned from."""
    keys = docs.where("id is not null and lang is not null").select("id", "lang")
    langs = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("count"))  # a row for each label
    # far more than the sample, in the order of the hash, but not a language's rows all in one task
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    few = place < F.lit(float(1 << 40)) * (4 * docs_each + 200) / F.col("count")
    keys = keys.join(F.broadcast(langs), "lang").where(few).select("id", "lang").distinct()
    keys = keys.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))).where(F.col("place") <= docs_each)
    rows = docs.join(F.broadcast(keys), ["id", "lang"]).where(F.length("text") <= SAMPLE_CHARS)
    rows = rows.groupBy("lang", "place").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    most = F.lit(model_values) / F.pow(F.lit(max(1, langs.count())), 2)
    before = F.sum(F.length("row.text")).over(Window.partitionBy("lang").orderBy("place"))
    return rows.withColumn("chars", before).where((F.col("chars") <= most) | (F.col("chars") == F.length("row.text"))).select("lang", "row.text", "place")


def learned(docs: DataFrame, docs_each: int = SAMPLE_DOCS, order: int = ORDER, model_values: int = MODEL_VALUES) -> Model:
    """The models, learned from the bounded sample; docs: id, text, lang of the rows that may be learned from."""
    rows = sampled(docs, docs_each, model_values).collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    texts: dict[str, list[str]] = {}
    for r in rows:
        if r["place"] % 5:
            texts.setdefault(r["lang"], []).append(r["text"])
    model = Model(texts, order)
    held = [r for r in rows if not r["place"] % 5]
    model.calibrate([r["text"] for r in held], [r["lang"] for r in held])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            lang, score, entropy, rejected = shared.value.predict(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(docs, apply, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op2_language_id": op2_language_id}
