"""State machines over ordered rows of a key, one group per key; the streaming processors share their steps."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_key(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """step over each key's rows in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return step(rows.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


class OnlineConformal:
    """A correction per market: emitted with the current one, updated when an outcome matures by the miss it made then."""

    def __init__(self, rate: float, level: float, correction: float = 0.0) -> None:
        self.rate, self.level, self.correction = rate, level, correction
        self.pending: deque[tuple[float, float]] = deque()

    def emit(self, radius: float) -> float:
        used = radius + self.correction
        self.pending.append((used, radius))
        return used

    def mature(self, errors: list[float]) -> None:
        used, _ = self.pending.popleft()
        miss = sum(e > used for e in errors) / len(errors)
        self.correction += self.rate * (miss - (1 - self.level))

    def cancel(self) -> None:
        """The oldest emission retires without an outcome and changes nothing."""
        self.pending.popleft()


class Gate:
    """CUSUM of standardised squared errors; the market's gate opens at the threshold."""

    def __init__(self, drift: float, threshold: float, decay: float) -> None:
        self.drift, self.threshold, self.decay = drift, threshold, decay
        self.square, self.cusum = None, 0.0

    def update(self, mean_square: float) -> tuple[float, float]:
        """(gate in [0, 1], cusum), from the errors' mean square against the running one before them."""
        if self.square is None:
            self.square = mean_square
            return 0.0, 0.0
        z = mean_square / self.square if self.square > 0 else 0.0
        self.cusum = min(max(self.cusum + z - 1 - self.drift, 0.0), self.threshold)
        self.square = self.decay * self.square + (1 - self.decay) * mean_square
        return self.cusum / self.threshold, self.cusum


class Hmm:
    """Forward filter with diagonal Gaussian emissions."""

    def __init__(self, start: np.ndarray, move: np.ndarray, means: np.ndarray, scales: np.ndarray) -> None:
        self.move, self.means, self.scales = move, means, scales
        self.state, self.started, self.log_likelihood = start, False, 0.0

    def update(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(filtered probabilities, probability of a change since the last row)."""
        prior = self.state @ self.move if self.started else self.state
        z = (x[None, :] - self.means) / self.scales
        density = np.exp(-0.5 * (z * z).sum(axis=1)) / np.prod(self.scales * np.sqrt(2 * np.pi), axis=1)
        joint = prior * density
        total = joint.sum()
        change = 0.0
        if self.started:
            stay = self.state * np.diag(self.move) * density
            change = 1.0 - float(stay.sum() / total)
        self.state, self.started = joint / total, True
        self.log_likelihood += float(np.log(total))
        return self.state, change


class Mixture:
    """AdaNormalHedge over experts: weights from the regrets of matured losses."""

    def __init__(self, experts: int) -> None:
        self.regret, self.size = np.zeros(experts), np.zeros(experts)

    def weights(self) -> np.ndarray:
        def potential(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            return np.exp(np.maximum(r, 0) ** 2 / (3 * c))

        c = self.size + 1
        w = 0.5 * (potential(self.regret + 1, c) - potential(self.regret - 1, c))
        w = np.maximum(w, 0)
        return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))

    def update(self, weights: np.ndarray, losses: np.ndarray) -> None:
        r = float(weights @ losses) - losses
        self.regret += r
        self.size += np.abs(r)


class Portfolio:
    """Cash and holdings: orders are decided at one close, executed at the next open under capacity and tax, marked at its close."""

    def __init__(self, cash: float, lot: int = 1, sell_tax: float = 0.001) -> None:
        self.cash, self.lot, self.sell_tax = cash, lot, sell_tax
        self.held: dict[str, int] = {}
        self.orders: dict[str, int] = {}

    def session(self, opens: dict[str, float], closes: dict[str, float], capacity: dict[str, int]) -> dict[str, float]:
        traded = taxes = 0.0
        unfilled = 0
        for asset, want in sorted(self.orders.items(), key=lambda o: (o[1] > 0, o[0])):  # sales first
            price = opens.get(asset)
            if price is None or price <= 0:
                unfilled += 1
                continue
            change = want - self.held.get(asset, 0)
            change = int(np.clip(change, -capacity.get(asset, 0), capacity.get(asset, 0)))
            if change > 0:
                change = min(change, int(self.cash // price))
            change = int(change / self.lot) * self.lot
            tax = -change * price * self.sell_tax if change < 0 else 0.0
            self.cash -= change * price + tax
            self.held[asset] = self.held.get(asset, 0) + change
            traded += abs(change) * price
            taxes += tax
            unfilled += self.held[asset] != want
        self.orders = {}
        value = self.cash + sum(n * closes.get(a, opens.get(a, 0.0)) for a, n in self.held.items())
        return {"value": value, "cash": self.cash, "traded": traded, "taxes": taxes, "unfilled": float(unfilled)}


class Leaderboard:
    """Publishes a score only if it beats the best by the margin; the ladder mechanism."""

    def __init__(self, margin: float) -> None:
        self.margin, self.best = margin, float("inf")

    def submit(self, score: float) -> float:
        if score < self.best - self.margin:
            self.best = round(score / self.margin) * self.margin
        return self.best


def replay(rows: pd.DataFrame, make: Callable[[], object], use: Callable[[object, object], Iterator | tuple], names: list[str]) -> pd.DataFrame:
    """A machine over the rows; `use` gives the values of `names` for each."""
    machine = make()
    values = [use(machine, r) for r in rows.itertuples(index=False)]
    return pd.DataFrame(values, columns=names)
