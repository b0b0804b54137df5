"""Counter-based noise: a row's draws depend on its key and block alone, whatever the order or the partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the SplitMix64 generator.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix(counter: np.ndarray) -> np.ndarray:
    """The generator's output at each unsigned 64-bit counter."""
    z = (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def _uniform(counter: pd.Series) -> pd.Series:
    return pd.Series((splitmix(counter.to_numpy(np.int64).view(np.uint64)) >> np.uint64(11)) * 2.0**-53)


def _normal(counter: pd.Series) -> pd.Series:
    c = counter.to_numpy(np.int64).view(np.uint64) * np.uint64(2)
    a, b = ((splitmix(x) >> np.uint64(11)) * 2.0**-53 for x in (c, c + np.uint64(1)))
    return pd.Series(np.sqrt(-2 * np.log1p(-a)) * np.cos(2 * np.pi * b))


def uniform(counter: Column) -> Column:
    """A draw in [0, 1) for each LONG counter."""
    return F.pandas_udf(_uniform, "double")(counter)


def normal(counter: Column) -> Column:
    """A standard normal draw for each LONG counter (Box-Muller over two uniforms)."""
    return F.pandas_udf(_normal, "double")(counter)
