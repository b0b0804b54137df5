"""Small-sample inference on the driver, over tables that are already aggregated to days, replicates or models."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
EULER = 0.5772156649015329


def deflated_sharpe(ratio: float, trials: int, variance: float, n: int, skewness: float, kurtosis: float) -> float:
    """Probability that a Sharpe ratio exceeds the expected best of `trials` unskilled ones; one trial gives the probabilistic ratio."""
    best = 0.0
    if trials > 1:
        best = variance**0.5 * ((1 - EULER) * _NORMAL.inv_cdf(1 - 1 / trials) + EULER * _NORMAL.inv_cdf(1 - 1 / (trials * np.e)))
    spread = (1 - skewness * ratio + (kurtosis - 1) / 4 * ratio**2) ** 0.5
    return _NORMAL.cdf((ratio - best) * (n - 1) ** 0.5 / spread)


def diebold_mariano(differences: np.ndarray, lags: int) -> float:
    """The statistic with a rectangular kernel of `lags` autocovariances and the small-sample correction; NaN if the variance isn't positive."""
    d = np.asarray(differences, float)
    n, c = len(d), d - d.mean()
    variance = (c @ c / n + 2 * sum(c[k:] @ c[:-k] / n for k in range(1, lags + 1))) / n
    if variance <= 0:
        return float("nan")
    h = lags + 1
    return float(d.mean() / variance**0.5 * ((n + 1 - 2 * h + h * (h - 1) / n) / n) ** 0.5)


def holm(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(np.maximum.accumulate((len(p) - np.arange(len(p))) * p[order]), 1)
    return out


def step_down(observed: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Adjusted p-values of the largest studentised statistics against resampled ones (replicates by hypotheses), stepping down."""
    observed, draws = np.abs(np.asarray(observed, float)), np.abs(np.asarray(draws, float))
    order, out, last = np.argsort(-observed, kind="stable"), np.empty(len(observed)), 0.0
    for k, h in enumerate(order):
        most = draws[:, order[k:]].max(axis=1)
        last = max(last, (1 + (most >= observed[h]).sum()) / (1 + len(draws)))
        out[h] = last
    return out


def family_intervals(point: np.ndarray, draws: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) percentile intervals widened to hold simultaneously: the same studentised width for all."""
    point, draws = np.asarray(point, float), np.asarray(draws, float)
    scale = draws.std(axis=0, ddof=1)
    scale = np.where(scale > 0, scale, np.inf)
    most = (np.abs(draws - point) / scale).max(axis=1)
    width = np.quantile(most, level) * np.where(np.isfinite(scale), scale, 0)
    return point - width, point + width


def decide(low: float, high: float, margin: float, seed_band: float) -> str:
    """A variant against a control (smaller losses are negative): superior, equivalent, non_inferior, inferior, undecided or not_interpretable."""
    if not np.isfinite([low, high]).all() or high < low:
        return "not_interpretable"
    if high - low < seed_band:
        return "not_interpretable"
    if high < 0:
        return "superior"
    if low > margin:
        return "inferior"
    if low > -margin and high < margin:
        return "equivalent"
    return "non_inferior" if high < margin else "undecided"
