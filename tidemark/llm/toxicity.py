"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Everything is learned from a bounded sample of labelled documents: the SAMPLE rows with the smallest
hash of their doc_id, dealt by another hash of it into three folds. The first gives the lexicon:
words and word beginnings that stand in toxic documents far more often than elsewhere, by their
log-likelihood ratio, LEXICON of them at most. The second fits the trees, the third the isotonic
map from margins to probabilities, which makes up for the lexicon and trees having seen their folds.

Features of a whole text: densities and counts of lexicon hits (plain, by weight, and only after
undoing obfuscation), nearness of second-person words to hits, capitals, punctuation and
obfuscation rates, and sizes. Null and empty texts have the features of no words and are scored
like any other. Without labels of both kinds every score is the share of toxic labels (0 for none).
Rows with null doc_id or null label are not learned from; of conflicting labels the toxic one counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded, claim, in_slices, mapped, slices

SAMPLE, LEXICON, LEAST_DOCS = 15_000, 600, 4
TREES, DEPTH, RATE, BINS, LEAF = 120, 3, 0.1, 64, 10
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})
_WORD = re.compile(r"[^\W_]+")
_CHUNK = re.compile(r"\S+")
_PLAIN = re.compile(r"[^\W\d_]+[.,;:!?|]*")
_LENGTHS = (4, 5, 6)
FEATURES = (
    "hits", "hit_density", "weight", "weight_density", "top_weight", "distinct", "strong", "strong_density", "stems", "stem_density", "hidden", "hidden_density",
    "near_you", "you_density", "capitals", "shouted", "marks", "exclaimed", "mixed", "stretched", "words", "variety",
)
#: Weight (log-odds) from which an entry is strong; words kept by a worker.
STRONG, MEMO = 3.0, 300_000


def terms(word: str) -> list[str]:
    """The lexicon entries a lower-case word may match: itself, and its beginnings, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in _LENGTHS if len(word) > n)]


class Features:
    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.memo: dict[str, tuple[float, float]] = {}

    def _look(self, word: str) -> tuple[float, float]:
        """(weight of the word itself, of its best beginning); 0 for none."""
        found = self.memo.get(word)
        if found is None:
            get = self.lexicon.get
            found = get(word, 0.0), max((get(t, 0.0) for t in terms(word)[1:]), default=0.0)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        words = _WORD.findall(text.lower())
        n = len(words)
        look = self._look
        hits = stems = strong = 0
        weight = top = 0.0
        places: list[int] = []
        kinds = set()
        for i, w in enumerate(words):
            own, stem = look(w)
            if own or stem:
                if own:
                    hits += 1
                else:
                    stems += 1
                best = max(own, stem)
                weight += best
                top = max(top, best)
                strong += best >= STRONG
                kinds.add(w)
                places.append(i)
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0.0
        if you and places:
            at = np.searchsorted(you, places)
            for p, k in zip(places, at.tolist(), strict=True):
                gap = min((abs(you[j] - p) for j in (k - 1, k) if 0 <= j < len(you)), default=99)
                near += 1 / (1 + gap)
        hidden = mixed = 0
        chunks = _CHUNK.findall(text)
        for c in set(chunks):
            if not _PLAIN.fullmatch(c) and any(x.isalpha() for x in c):
                clear = c.lower().translate(DISGUISES)
                if not c.isdigit():
                    mixed += 1
                if clear != c.lower() and clear.isalpha() and max(look(clear)):
                    hidden += not any(max(look(w)) for w in _WORD.findall(c.lower()))
        letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.sub("[^A-Za-z]+", "", text))
        upper = len(re.sub("[^A-Z]+", "", text)) if text.isascii() else sum(map(str.isupper, text))
        shouted = sum(1 for c in chunks if len(c) > 2 and c.isupper())
        marks = len(text) - letters - text.count(" ") - text.count("\n")
        base, chars = max(n, 1), max(len(text), 1)
        return [
            hits, hits / base, weight, weight / base, top, len(kinds), strong, strong / base, stems, stems / base, hidden, hidden / base,
            near, len(you) / base, upper / max(letters, 1), shouted / max(len(chunks), 1), marks / chars, text.count("!") / base, mixed / base,
            len(re.findall(r"(\w)\1\1", text)) / base, math.log1p(n), len(set(words)) / base,
        ]


class Trees:
    """Boosted trees for log-loss over binned features; a level at a time, all nodes of it from one histogram."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        margin = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS, np.int64)
            node = np.zeros(len(y), np.int64)
            for depth in range(DEPTH):
                first, count = (1 << depth) - 1, 1 << depth
                best = np.zeros(count)
                for f in range(x.shape[1]):
                    slot = (node - first) * BINS + binned[:, f]
                    gs = np.bincount(slot, g, count * BINS).reshape(count, BINS).cumsum(axis=1)
                    hs = np.bincount(slot, h, count * BINS).reshape(count, BINS).cumsum(axis=1)
                    ns = np.bincount(slot, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                    total_g, total_h, total_n = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(ns < LEAF) | (total_n - ns < LEAF)] = -1
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(count), at] > best + 1e-9
                    best = np.where(better, gain[np.arange(count), at], best)
                    feature[first : first + count] = np.where(better, f, feature[first : first + count])
                    cut[first : first + count] = np.where(better, at, cut[first : first + count])
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << DEPTH) - 1)
            value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - ((1 << DEPTH) - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: places and non-decreasing values, between which the map is linear."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weighted sum of x, of y, weight
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], prior: float, trees: Trees | None = None, places: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.features, self.prior, self.trees, self.places, self.values = Features(lexicon), prior, trees, places, values

    def __getstate__(self) -> dict:
        self.features.memo.clear()
        return self.__dict__

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        margin = self.trees.margins(np.array([self.features.of(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES)))
        return np.clip(np.interp(margin, self.places, self.values), 0.0, 1.0)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in toxic and other texts, and the texts it stands in, of one partition."""
    uses: tuple[Counter, Counter] = (Counter(), Counter())
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    for piece in slices(batches):
        for toxic, text in zip(piece.column("toxic").to_pylist(), piece.column("text").to_pylist(), strict=True):
            own: Counter = Counter()
            for w, n in Counter(_WORD.findall((text or "").lower())).items():
                for t in terms(w):
                    own[t] += min(n, 3)  # a text that repeats a word says little more
            uses[toxic].update(own)
            docs[toxic].update(own.keys())
    for toxic in (0, 1):
        for at in range(0, len(uses[toxic]), 20_000):
            some = list(uses[toxic])[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.string()), "toxic": pa.array([toxic] * len(some), pa.int32()), "uses": pa.array([uses[toxic][t] for t in some], pa.int64()), "docs": pa.array([docs[toxic][t] for t in some], pa.int64())})


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Terms with their log-odds in toxic against other texts; rows: text, toxic."""
    counts = mapped(rows.select("text", "toxic"), _count_terms, "term string, toxic int, uses long, docs long")
    counts = counts.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for c in ("uses", "docs") for k in (0, 1)])
    total = {int(r["toxic"]): float(r["n"]) for r in rows.groupBy("toxic").agg((F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))), F.lit(0)) + 1).alias("n")).collect()}
    if len(total) < 2:
        return {}
    share = total[1] / (total[0] + total[1])
    a, b = F.col("uses1").cast("double"), F.col("uses0").cast("double")
    odds = F.log((a + 0.5) / F.lit(total[1])) - F.log((b + 0.5) / F.lit(total[0]))
    part = lambda x, e: F.when(x > 0, x * F.log(x / ((a + b) * e))).otherwise(0.0)
    gain = 2 * (part(a, share) + part(b, 1 - share))
    best = counts.where((F.col("docs1") >= LEAST_DOCS) & (odds > 1) & (F.col("docs1") > F.col("docs0") * F.lit(share))).select("term", odds.alias("odds"), gain.alias("gain"))
    return {r["term"]: float(r["odds"]) for r in best.where("gain > 15").orderBy(F.desc("gain"), "term").limit(size).collect()}


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: id, text of the rows that may be learned from; labels: id, toxic of those."""
    labels = labels.where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    labels = labels.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)))
    rows = docs.join(F.broadcast(labels), "id").select("id", "text", "toxic", "fold")  # the sample's size bounds the broadcast
    first = rows.where("fold < 4")
    lexicon = learn_lexicon(first)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features(lexicon)
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("id", "fold", "toxic")), pa.array([maker.of(t) for t in piece.column("text").to_pylist()], pa.list_(pa.float64()))], names=["id", "fold", "toxic", "x"])

    found = mapped(rows.where("fold >= 4"), features, "id long, fold long, toxic int, x array<double>").limit(4 * sample).collect()
    found.sort(key=lambda r: (r["id"], r["x"]))
    fit, hold = [r for r in found if r["fold"] < 8], [r for r in found if r["fold"] >= 8]
    y = np.array([r["toxic"] for r in fit], np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    z = np.array([r["toxic"] for r in hold], np.float64)
    if not len(z) or not 0 < y.sum() < len(y):
        return Model(lexicon, prior)
    trees = Trees().fit(np.array([r["x"] for r in fit], np.float64), y)
    return Model(lexicon, prior, trees, *isotonic(trees.margins(np.array([r["x"] for r in hold], np.float64)), z))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with the column `name` (0 to 1) beside its own; a column of that name must not be there."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name!r}: give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and TREES

    def apply(batches):
        claim("toxicity", shared.value.features.memo.clear)
        for batch in batches:
            yield in_slices(batch, lambda texts: pa.array(shared.value.scores(texts), pa.float64()), pa.float64())

    toxicity = F.arrow_udf(apply, "double", F.ArrowUDFType.SCALAR_ITER)
    return bounded(docs).withColumn(name, toxicity(F.col(text_col)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned_from(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the driver's tables, without the rows held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return learned(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text"), labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "toxic"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, learned_from(spark, docs, sf_dir), name="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
