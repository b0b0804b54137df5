"""Vector operators. A search is one job over a grid: rows are dealt into chunks, queries are sent to every chunk, and a task holds one chunk while queries stream past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a chunk and queries handled at a time.
CHUNK, BLOCK = 1 << 14, 4096


def _grid(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, extra: str | None, apply: Callable, schema: str, chunk: int, block: int) -> DataFrame:
    """apply(ids, matrix, extra of a chunk, query ids, query matrix) as a table, for every chunk of rows and block of queries; rows without a vector take no part.

    A query row stands for itself: queries with the same id, or none, are all answered.
    """
    kind = dict(rows.dtypes)[id_col]
    chunks = max(1, -(-rows.count() // chunk))
    value = F.col(extra).cast("double") if extra else F.lit(0.0)
    vector = F.col(vector_col).cast("array<double>")
    a = rows.where(F.col(vector_col).isNotNull()).select(F.pmod(F.xxhash64(id_col, vector_col), F.lit(chunks)).alias("chunk"), F.lit(0).alias("side"), F.col(id_col).alias("id"), vector.alias("x"), value.alias("v"))
    b = queries.where(F.col(vector_col).isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(1).alias("side"), F.col(id_col).cast(kind).alias("id"), vector.alias("x"), F.lit(0.0).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        ready, at = None, None
        for batch in batches:
            for (number, side), part in batch.groupby(["chunk", "side"], sort=True):
                if number != at:
                    held, ready, at = [], None, number
                if side == 0:
                    held.append(part)
                    continue
                if ready is None and held:
                    whole = pd.concat(held)
                    ready, held = (whole["id"].to_numpy(), np.stack(whole["x"].to_numpy()), whole["v"].to_numpy()), []
                for start in range(0, len(part), block):
                    some = part.iloc[start : start + block]
                    if ready is not None:
                        yield apply(*ready, some["id"].to_numpy(), np.stack(some["x"].to_numpy()))

    return a.unionByName(b).repartition("chunk").sortWithinPartitions("chunk", "side").mapInPandas(run, schema)


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, id, similarity: the k rows of the largest inner product with each query's id, rows of its own id left out; ties go to the smaller id."""

    def search(ids: np.ndarray, matrix: np.ndarray, _: np.ndarray, own: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        scores = m @ matrix.T
        scores[own[:, None] == ids[None, :]] = -np.inf
        found = []
        for q in range(len(own)):
            s = scores[q]
            edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            some = np.flatnonzero((s >= edge) & np.isfinite(s))  # all that tie at the edge, too
            some = some[np.lexsort((ids[some], -s[some]))][:k]
            found.append(pd.DataFrame({"query_id": own[q], "id": ids[some], "similarity": s[some]}))
        return pd.concat(found)

    kind = dict(rows.dtypes)[id_col]
    # a query that stands there twice is the same question
    out = _grid(rows, queries.dropDuplicates([id_col]), id_col, vector_col, None, search, f"query_id {kind}, id {kind}, similarity double", chunk, block)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kernel_regression(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, value_col: str, temperature: float, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, estimate: softmax-weighted mean of the values of all other rows; the chunks' partial sums are shifted by their greatest logit."""

    def weigh(ids: np.ndarray, matrix: np.ndarray, values: np.ndarray, own: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        logits = m @ matrix.T / temperature
        logits[own[:, None] == ids[None, :]] = -np.inf
        top = logits.max(axis=1)
        some = np.isfinite(top)
        w = np.exp(logits[some] - top[some, None])
        return pd.DataFrame({"query_id": own[some], "top": top[some], "total": w.sum(axis=1), "value": w @ values})

    kind = dict(rows.dtypes)[id_col]
    out = _grid(rows, queries.dropDuplicates([id_col]), id_col, vector_col, value_col, weigh, f"query_id {kind}, top double, total double, value double", chunk, block)
    most = Window.partitionBy("query_id")
    out = out.withColumn("shift", F.exp(F.col("top") - F.max("top").over(most)))
    return out.groupBy("query_id").agg((F.sum(F.col("value") * F.col("shift")) / F.sum(F.col("total") * F.col("shift"))).alias("estimate"))


def mean_vector(rows: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """keys, place, mean: the mean vector of each key, a row for each place."""
    return rows.select(*keys, F.posexplode(vector_col).alias("place", "x")).groupBy(*keys, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def squared_medoid(rows: DataFrame, key: str, id_col: str, vector_col: str) -> DataFrame:
    """key, id: the row of the least sum of squared distances to its key's rows, from n |x|^2 - 2 x.S without any pairs."""
    sums = rows.select(key, F.posexplode(vector_col).alias("place", "x")).groupBy(key, "place").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda p: p["s"]).alias("s"))
    j = rows.join(sums, key)
    dot = F.aggregate(F.zip_with(vector_col, "s", lambda x, s: F.col("n") * x.cast("double") * x.cast("double") - 2 * x.cast("double") * s), F.lit(0.0), lambda a, x: a + x)
    return j.withColumn("cost", dot).groupBy(key).agg(F.min_by(id_col, F.struct(F.round("cost", 6), F.col(id_col))).alias(id_col))


def farthest_first(rows: DataFrame, first: int, k: int, id_col: str, vector_col: str) -> list[int]:
    """Ids of k rows, each the farthest from those before it (ties to the smaller id): k passes, one row on the driver at a time."""
    chosen, centre = [first], rows.where(F.col(id_col) == first).select(vector_col).first()[0]
    distances = rows.select(id_col, vector_col, F.lit(float("inf")).alias("least"))
    for _ in range(k - 1):
        c = F.array(*[F.lit(float(x)) for x in centre])
        own = F.aggregate(F.zip_with(vector_col, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
        distances = distances.withColumn("least", F.least("least", own))
        best = distances.orderBy(F.desc("least"), id_col).first()
        chosen.append(best[id_col])
        centre = best[vector_col]
    return chosen
