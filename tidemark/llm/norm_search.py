"""Exact top-k inner-product search over norm buckets.

Vectors become integers, floor(SCALE * x), and are dealt by ranges of length (norm) into slabs of about
SLAB rows, the longest first, and in a slab into buckets of BUCKET rows. Queries get a first threshold,
the (k + 1)-th best score over the SEEDS longest vectors, and go to the slabs whose longest vector can
reach it (length pruning of whole slabs). One job handles the whole grid of slabs and pieces of CELL
queries: a task holds one slab in memory and reads the queries that come to it one batch after the
other. For each bucket and query the best known k-th score, divided by the lengths of the query and of
the bucket's longest vector, is a local cosine threshold:

* above 1, no vector of the bucket can enter the result, and the bucket is skipped (length pruning
  of a whole bucket); within a bucket the same test drops its shorter vectors;
* where it is at least COORDINATE, coordinate pruning first: a unit vector within the threshold of
  the query's can differ from it in a coordinate only by a bounded amount, so the candidates are
  those whose values of the query's FOCUS largest coordinates lie in the feasible intervals, found
  by binary search in the bucket's sorted coordinate lists;
* the inner products of what is left are then computed exactly, as integers.

All bounds are widened by a relative error margin, so that rounding drops no result. The driver holds
the seeds (of the SEEDED dimensions with the most queries; others begin without a threshold) and one
row for each slab.

Rows take part if vec_id isn't null and the vector is neither null nor holds a null or non-finite
component. Vectors of another dimension than the query's are no candidates. A query's own row is one
row with its vec_id and vector; other rows with the same vec_id are candidates, and each query row
gets its own results. Scores beyond a LONG are returned as the nearest LONG.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._shared import mapped, written

SCALE, K, BUCKET, SEEDS, SEEDED = 1024, 10, 1024, 2048, 8
#: Vectors of a slab and queries of a piece of the grid; a table too small for many slabs is dealt into smaller ones.
SLAB, CELL = 1 << 15, 1 << 16
#: Components of queries that a task handles at a time (8 bytes each), from which cosine coordinates prune, and how many coordinates.
BLOCK_VALUES, COORDINATE, FOCUS = 1 << 19, 0.5, 3
_SLACK = 1e-9
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole(vectors: list[list[float]] | np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as float64 where every product of two of them is exact in any order, else as Python integers."""
    x = np.asarray(vectors, np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if y.size and (not np.isfinite(y).all() or float(np.abs(y).max()) >= math.sqrt(2**53 / y.shape[1])):
        return np.array([[math.floor(v * SCALE) if abs(v) < 2**50 else int(v) * SCALE for v in row] for row in x.tolist()], object).reshape(x.shape)
    return y


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if queries.dtype != object and rows.dtype != object:
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
        if bound < 2**53:
            return queries @ rows.T
        queries, rows = queries.astype(object), rows.astype(object)
    return np.array([[sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in rows] for q in queries], object).reshape(len(queries), len(rows))


def lengths(rows: np.ndarray) -> np.ndarray:
    if rows.dtype == object:  # beyond the range of a float the length is infinite, which prunes nothing
        return np.array([math.sqrt(n) if (n := sum(int(v) * int(v) for v in r)) < 10**300 else math.inf for r in rows])
    return np.sqrt((rows * rows).sum(axis=1))


class Bucket:
    """Vectors of like length, the longest first, with sorted lists of the coordinates that were asked for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> None:
        self.ids, self.rows, self.norms = ids, rows, norms
        self.plain = rows.dtype == object or not np.isfinite(norms[0]) or not norms[0]
        self.unit = None if self.plain else rows / np.maximum(norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = (order, self.unit[order, f])
        return self.lists[f]


def buckets(ids: np.ndarray, rows: np.ndarray) -> list[Bucket]:
    norms = lengths(rows)
    order = np.argsort(-norms, kind="stable")
    ids, rows, norms = ids[order], rows[order], norms[order]
    return [Bucket(ids[at : at + BUCKET], rows[at : at + BUCKET], norms[at : at + BUCKET]) for at in range(0, len(ids), BUCKET)]


class Best:
    """The best scores of each query of a block, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, keep: int, least: np.ndarray | None = None) -> None:
        self.queries, self.keep = queries, keep
        self.lengths = lengths(queries)
        self.unit = np.where(np.isfinite(self.lengths)[:, None] & (self.lengths > 0)[:, None], queries.astype(np.float64) / np.maximum(np.where(np.isfinite(self.lengths), self.lengths, 1), 1)[:, None], 0) if queries.dtype != object else None
        self.top: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]  # (-score, id), sorted
        self.least = np.full(len(queries), -math.inf) if least is None else least.astype(np.float64)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.least[q]
        if not some.any():
            return
        ids, scores = ids[some], scores[some]
        merged = self.top[q] + [(-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        merged.sort()
        self.top[q] = merged[: self.keep]
        if len(self.top[q]) == self.keep:
            self.least[q] = max(self.least[q], _down(-self.top[q][-1][0]))

    def bucket(self, b: Bucket) -> None:
        """One bucket."""
        if self.unit is None or b.plain:
            scores = products(self.queries, b.rows)
            for q in range(len(self.queries)):
                self.add(q, b.ids, scores[q])
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.lengths > 0, self.least / (self.lengths * b.norms[0]), np.where(self.least > 0, np.inf, -np.inf))
        plain = []
        for q in np.flatnonzero(local <= 1 + _SLACK).tolist():
            if local[q] < COORDINATE:
                plain.append(q)
                continue
            need = self.least[q] / self.lengths[q] * (1 - _SLACK)
            n = int(np.searchsorted(-b.norms, -need, side="right"))  # shorter ones can't reach the threshold
            chosen = self._feasible(q, max(0.0, min(1.0, local[q]) - _SLACK), b)
            chosen = chosen[chosen < n]
            if len(chosen):
                self.add(q, b.ids[chosen], products(self.queries[q : q + 1], b.rows[chosen])[0])
        if plain:
            scores = products(self.queries[plain], b.rows)
            hits = (scores >= self.least[plain][:, None]).any(axis=1)
            for k in np.flatnonzero(hits).tolist():
                self.add(plain[k], b.ids, scores[k])

    def _feasible(self, q: int, cosine: float, b: Bucket) -> np.ndarray:
        """Places in the bucket whose focus coordinates a vector of at least that cosine may have."""
        own, found = self.unit[q], None
        for f in np.argsort(-np.abs(own))[:FOCUS].tolist():
            order, values = b.sorted(f)
            middle = own[f] * cosine
            reach = math.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - own[f] * own[f])) + 1e-7
            # a larger cosine moves the middle towards own[f]: the interval spans all cosines from the threshold up to 1
            first = np.searchsorted(values, -1.0 if own[f] < 0 and cosine < -own[f] else min(middle, own[f]) - reach, side="left")
            last = np.searchsorted(values, 1.0 + 1e-7 if own[f] > 0 and cosine < own[f] else max(middle, own[f]) + reach, side="right")
            here = order[first:last]
            found = here if found is None else np.intersect1d(found, here, assume_unique=True)
            if not len(found):
                break
        return np.sort(found)


def _down(score: int) -> float:
    """A float not above an integer."""
    if abs(score) < 2**53:
        return float(score)
    try:
        return math.nextafter(float(score), -math.inf)
    except OverflowError:
        return -math.inf if score < 0 else 1e308


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return whole(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim))


def _seeds(stored: DataFrame, slabs: DataFrame, wanted: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the ids and integers of the longest vectors of the first slab, BLOCK_VALUES components at most."""
    dims = wanted.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(SEEDED).select("dim")
    first = slabs.join(F.broadcast(dims), "dim").groupBy("dim").agg(F.min("slab").alias("slab"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("norm"), "id"))
    rows = stored.join(F.broadcast(first), ["dim", "slab"]).withColumn("place", place).where((F.col("place") <= most) & (F.col("place") * F.greatest("dim", F.lit(1)) <= BLOCK_VALUES)).select("dim", "id", "x").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["dim"], []).append(r)
    return {dim: (np.array([r["id"] for r in some], np.int64), whole([r["x"] for r in some])) for dim, some in found.items()}


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", slab: int = SLAB, cell: int = CELL, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries`, itself (one equal row) left out."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("dim", F.size("x"))
    wanted = written(pick(queries).withColumn("uid", F.monotonically_increasing_id()), "queries")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + (x * SCALE) * (x * SCALE)))
    sized = pick(vectors).withColumn("norm", norm).withColumn("tie", F.xxhash64("id", F.monotonically_increasing_id()))
    total = sized.count()
    count = max(1, math.ceil(total / slab), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET))
    stored = written(sized.repartitionByRange(count, F.desc("norm"), "tie").withColumn("slab", F.spark_partition_id()).drop("tie"), "vectors")
    slabs = written(stored.groupBy("dim", "slab").agg(F.max("norm").alias("longest")).coalesce(1), "slabs")
    pieces = max(1, math.ceil(wanted.count() / cell))
    shared = spark.sparkContext.broadcast(_seeds(stored, slabs, wanted, max(k + 1, SEEDS)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, piece in _blocks(batches, ["dim"], block_values):
            q = _matrix(piece, dim)
            best = Best(q, k + 1)
            for b in buckets(*shared.value[dim]) if dim in shared.value else ():
                best.bucket(b)
            least = [_down(-t[-1][0]) if len(t) == k + 1 else -math.inf for t in best.top]
            own = [_long(products(q[i : i + 1], q[i : i + 1])[0][0]) for i in range(len(q))]
            columns = {"uid": piece.column("uid"), "id": piece.column("id"), "x": piece.column("x"), "dim": piece.column("dim"), "least": pa.array(least), "norm": pa.array(lengths(q)), "own": pa.array(own, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    begun = written(mapped(wanted.select("uid", "id", "x", "dim"), begin, "uid long, id long, x array<double>, dim int, least double, norm double, own long"), "begun")
    # left out only where the product of both lengths is below the threshold by more than rounding and taking floors can change
    out = (F.col("least") > F.col("norm") * (F.col("longest") + F.sqrt("dim")) * (1 + 1e-9)) & (F.col("longest") < float("inf"))
    sent = begun.join(F.broadcast(slabs), "dim").where(~out).withColumn("piece", F.pmod(F.xxhash64("uid"), F.lit(pieces)).cast("int"))
    sent = sent.select("dim", "slab", "piece", F.lit(1).alias("side"), "uid", "id", "x", "least", "own")
    held = stored.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))) if pieces > 1 else F.lit(0))
    held = held.select("dim", "slab", "piece", F.lit(0).alias("side"), F.lit(0).cast("long").alias("uid"), "id", "x", F.lit(0.0).alias("least"), F.lit(0).cast("long").alias("own"))
    grid = held.unionByName(sent).repartition("dim", "slab", "piece").sortWithinPartitions("dim", "slab", "piece", "side")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, here = None, [], [], []
        for key, piece in _blocks(batches, ["dim", "slab", "piece", "side"], block_values):
            if key[:3] != at:
                at, ids, rows, here = key[:3], [], [], []
            part = _matrix(piece, key[0])
            if not key[3]:
                ids.append(piece.column("id").to_numpy())
                rows.append(part)
                continue
            if ids:
                here = buckets(np.concatenate(ids), np.concatenate(rows))
                ids, rows = [], []
            best = Best(part, k + 1, piece.column("least").to_numpy())
            for b in here:
                best.bucket(b)
            found = [(q, i, _long(-s)) for q, top in enumerate(best.top) for s, i in top]
            take = pa.array([r[0] for r in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*(piece.column(c).take(take) for c in ("uid", "id", "own")), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.int64())], names=["uid", "query_id", "own", "vec_id", "score"])

    found = mapped(grid, cells, "uid long, query_id long, own long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("vec_id")))
    kept = found.withColumn("place", place).where(F.col("place") <= k + 1)
    # the own row is one of those that equal it in id and score, the first of them
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    first = F.min(F.when(mine, F.col("place"))).over(Window.partitionBy("uid"))
    kept = kept.withColumn("gone", first).where(F.col("gone").isNull() | (F.col("place") != F.col("gone")))
    kept = kept.withColumn("rank", (F.col("place") - F.when(F.col("place") > F.col("gone"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    return kept.select("query_id", "rank", "vec_id", "score")


def _long(score: int) -> int:
    return min(max(int(score), _LONG[0]), _LONG[1])


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], values: int) -> Iterator[tuple]:
    """(key, rows) of runs of rows with equal keys, the first of which is the dimension, `values` components at most; of one key column the key is its value."""
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for start, stop in zip(edges, edges[1:], strict=False):
            key = tuple(int(c[start]) for c in columns)
            step = max(1, values // max(1, key[0]))
            for at in range(start, stop, step):
                yield key if len(keys) > 1 else key[0], batch.slice(at, min(step, stop - at))


def op7_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op7_norm_search": op7_norm_search}
ORACLE = {
    "op7_norm_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
