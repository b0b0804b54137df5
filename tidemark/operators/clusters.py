"""Clusterings of one key's vectors; a key is one task, so that its rows are bounded and larger keys refused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import Refused

#: Rows of a key that one task takes.
MOST = 4000


def _bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    if df.groupBy(key).count().where(F.col("count") > most).limit(1).count():
        raise Refused(f"a {key} has more than {most} rows")
    return df


def _matrix(rows: pd.DataFrame, vector_col: str) -> np.ndarray:
    return np.stack(rows[vector_col].to_numpy()).astype(np.float64)


def _far(x: np.ndarray, k: int) -> list[int]:
    chosen, least = [0], np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(least.argmax()))
    return chosen


def memberships(x: np.ndarray, clusters: int, iterations: int) -> np.ndarray:
    """Fuzzy c-means with exponent two from farthest-first centres; rows of weights that sum to one."""
    centres = x[_far(x, clusters)].copy()
    u = np.zeros((len(x), len(centres)))
    for _ in range(iterations):
        d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        hit = d <= 1e-18
        inverse = 1 / np.maximum(d, 1e-18)
        u = np.where(hit.any(axis=1)[:, None], hit / np.maximum(hit.sum(axis=1), 1)[:, None], inverse / inverse.sum(axis=1)[:, None])
        w = u**2
        centres = (w.T @ x) / np.maximum(w.sum(axis=0), 1e-18)[:, None]
    return u


def linkage(distance: np.ndarray, regions: int) -> np.ndarray:
    """Average-linkage regions: labels from zero by each region's first row."""
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(max(0, n - regions)):
        at = int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf)))
        i, j = sorted(divmod(at, n))
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i], d[i, i] = d[i], np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    names = {old: new for new, old in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([names[x] for x in label.tolist()])


def medoids(distance: np.ndarray, k: int) -> list[int]:
    """k-medoids by farthest-first seeds and the best swap until none helps; ties to the smaller index."""
    n = len(distance)
    chosen, least = [int(distance.sum(axis=0).argmin())], distance[int(distance.sum(axis=0).argmin())].copy()
    while len(chosen) < min(k, n):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distance[chosen[-1]])
    cost = distance[chosen].min(axis=0).sum()
    while True:
        best = None
        for a in range(len(chosen)):
            rest = chosen[:a] + chosen[a + 1 :]
            kept = distance[rest].min(axis=0) if rest else np.full(n, np.inf)
            total = np.minimum(kept[None, :], distance).sum(axis=1)
            total[chosen] = np.inf
            b = int(total.argmin())
            if total[b] < cost - 1e-12 and (best is None or total[b] < best[0]):
                best = (total[b], a, b)
        if best is None:
            return sorted(chosen)
        cost, chosen[best[1]] = best[0], best[2]


def embedding(x: np.ndarray, k: int) -> np.ndarray:
    """Top eigenvectors of the rows' correlation matrix, scaled by the root of their eigenvalue, the largest entry positive."""
    c = np.corrcoef(x)
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign)


def fuzzy_clusters(df: DataFrame, key: str, id_col: str, vector_col: str, clusters: int, iterations: int = 20, most: int = MOST) -> DataFrame:
    """key, id, weights per cluster."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col)
        u = memberships(_matrix(rows, vector_col), clusters, iterations)
        return pd.DataFrame({key: rows[key], id_col: rows[id_col], "weights": list(u)})

    return _bounded(df, key, most).select(key, id_col, vector_col).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, weights array<double>")


def regions(df: DataFrame, key: str, id_col: str, vector_col: str, count: int, most: int = MOST) -> DataFrame:
    """key, id, region: average linkage over one minus the correlation."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col)
        x = _matrix(rows, vector_col)
        label = linkage(1 - np.corrcoef(x), count) if len(x) > 1 else np.zeros(len(x), int)
        return pd.DataFrame({key: rows[key], id_col: rows[id_col], "region": label})

    return _bounded(df, key, most).select(key, id_col, vector_col).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, region int")
