"""Preparing many assets, storing what a replay reads again, and the surface for functions of the caller's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.clusters import _bounded, _matrix
from tidemark.operators.relational import Refused
from tidemark.sinks import publish


def prepare_cohort(assets: list[str], prepare: Callable[[str], DataFrame], root: str, spark: SparkSession, done: DataFrame | None = None) -> DataFrame:
    """Publishes each asset's table under root/<asset>; an asset that fails is a row of the result, not the end of the run.

    Assets that `done` confirms are left alone. The result, (asset, state, detail), is what to confirm with next time.
    """
    confirmed = {r[0] for r in done.where("state = 'prepared'").select("asset").collect()} if done is not None else set()
    rows = []
    for asset in sorted(set(assets) - confirmed):
        try:
            rows.append((asset, "prepared", publish.publish(prepare(asset), f"{root.rstrip('/')}/{asset}")))
        except Exception as e:  # whatever a source breaks with is that asset's state
            rows.append((asset, "failed", f"{type(e).__name__}: {e}"[:500]))
    new = spark.createDataFrame(rows, "asset string, state string, detail string")
    return new if done is None else done.where("state = 'prepared'").unionByName(new)


def write_blocks(df: DataFrame, path: str, key: str, at: str, size: int) -> None:
    """Sessions in order, `size` of them to a block, partitioned by block: what a reader by blocks prunes to."""
    sessions = df.select(key, at).distinct().withColumn("block", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1) / size).cast("int"))
    df.join(sessions, [key, at]).repartition(key, "block").sortWithinPartitions(key, at).write.partitionBy("block").mode("errorifexists").parquet(path)


def read_block(spark: SparkSession, path: str, block: int, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("block") == block)
    return df.select(*columns) if columns else df


def replay_blocks(spark: SparkSession, path: str, order: list[str], cursor: tuple[int, str] | None, prefix: list[str]) -> Iterator[tuple[DataFrame, tuple[int, str]]]:
    """The blocks after a cursor, each with the cursor that follows it: (blocks consumed, digest of them); a cursor whose digest isn't found again is Refused."""
    rows = spark.read.parquet(path)
    blocks = [r[0] for r in rows.select("block").distinct().orderBy("block").collect()]
    digest = lambda n: publish.content_digest(rows.where(F.col("block").isin(blocks[:n])).select(*prefix)) if n else ""
    done = 0
    if cursor is not None:
        done, stored = cursor
        if done > len(blocks) or digest(done) != stored:
            raise Refused("the archive isn't the one that the cursor read")
    for n in range(done, len(blocks)):
        yield rows.where(F.col("block") == blocks[n]).orderBy(*order), (n + 1, digest(n + 1))


def monthly_index(months: list[DataFrame], day: str, values: list[str]) -> DataFrame:
    """Monthly tables as one history by day; a day in two of them is Refused unless they agree."""
    out = None
    for df in months:
        part = df.select(day, *values)
        out = part if out is None else out.unionByName(part)
    g = out.groupBy(day).agg(F.countDistinct(F.struct(*values)).alias("_kinds"), F.min(F.struct(*values)).alias("_v"))
    if g.where("_kinds > 1").limit(1).count():
        raise Refused("two months disagree on a day")
    return g.select(day, "_v.*")


class Encoders:
    """What turns a modality into a vector: a spec that names it, a column for texts and one for price windows; no weights are trained."""

    def __init__(self, size: int = 384) -> None:
        self.size = size
        self.spec = {"text": f"signed word hashes, {size} places, unit length", "chart": "scaled candle geometry"}

    def text(self, text: Column) -> Column:
        """Words hashed with a sign into `size` places, of unit length; zero for no words."""
        h = F.transform(C.tokens(F.lower(text)), lambda w: F.xxhash64(w))
        total = F.aggregate(h, F.array_repeat(F.lit(0.0), self.size), lambda a, x: F.transform(a, lambda v, i: v + F.when(F.pmod(x, F.lit(self.size)) == i, F.when(F.shiftrightunsigned(x, 63) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
        norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, v: a + v * v))
        return F.transform(total, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))

    def chart(self, window: Column) -> Column:
        """Open, high, low, close of each slot over the window's highest high."""
        top = F.array_max(F.transform(window, lambda x: x["high"]))
        return F.flatten(F.transform(window, lambda x: F.array(*[x[c] / F.when(top > 0, top) for c in ("open", "high", "low", "close")])))


def consume(df: DataFrame, view: list[str], keys: list[str], function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a consumer makes of a view, joined to the keys; the consumer is given the keys and the view's columns only and has to return a row for each key."""
    found = function(df.select(*keys, *view))
    extra = [c for c in found.columns if c not in keys]
    j = df.select(*keys).join(found, keys, "left")
    if found.groupBy(*keys).count().where("count > 1").limit(1).count() or found.count() != df.count():
        raise Refused("a consumer returns one row for each key")
    return j.select(*keys, *extra)


#: Policies that decide without learning: a column of the observation's score and of the position held.
POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    "hold": lambda score, held: held,
    "flat": lambda score, held: F.lit(0.0),
    "follow": lambda score, held: F.signum(score),
    "half": lambda score, held: F.signum(score) * 0.5,
    "confident": lambda score, held: F.when(F.abs(score) >= 0.03, F.signum(score)).otherwise(held),
}


def policy(name: str, score: Column, held: Column) -> Column:
    if name not in POLICIES:
        raise Refused(f"no such policy: {name!r}")
    return POLICIES[name](score, held)


def anchored(distance: np.ndarray, fixed: list[int], k: int) -> list[int]:
    """k further medoids beside fixed ones: the greatest decrease first, then the best swap of a further one until none helps; ties to the smaller index."""
    n = len(distance)
    base = distance[fixed].min(axis=0) if fixed else np.full(n, np.inf)
    chosen: list[int] = []
    while len(chosen) < min(k, n - len(fixed)):
        least = np.minimum(base, distance[chosen].min(axis=0)) if chosen else base
        total = np.minimum(least[None, :], distance).sum(axis=1)
        total[[*fixed, *chosen]] = np.inf
        chosen.append(int(total.argmin()))
    while chosen:
        cost = np.minimum(base, distance[chosen].min(axis=0)).sum()
        best = None
        for a in range(len(chosen)):
            rest = chosen[:a] + chosen[a + 1 :]
            least = np.minimum(base, distance[rest].min(axis=0)) if rest else base
            total = np.minimum(least[None, :], distance).sum(axis=1)
            total[[*fixed, *chosen]] = np.inf
            b = int(total.argmin())
            if total[b] < cost - 1e-12 and (best is None or total[b] < best[0]):
                best = (total[b], a, b)
        if best is None:
            break
        chosen[best[1]] = best[2]
    return sorted(chosen)


def anchored_medoids(df: DataFrame, key: str, id_col: str, vector_col: str, fixed_col: str, k: int, most: int = 4000) -> DataFrame:
    """key, id, kind (fixed or chosen) of each key's centres: the rows that are fixed, and k more."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col).reset_index(drop=True)
        x = _matrix(rows, vector_col)
        distance = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
        fixed = np.flatnonzero(rows[fixed_col].to_numpy(bool)).tolist()
        some = [(i, "fixed") for i in fixed] + [(i, "chosen") for i in anchored(distance, fixed, k)]
        return pd.DataFrame({key: rows[key].iloc[[i for i, _ in some]].to_numpy(), id_col: rows[id_col].iloc[[i for i, _ in some]].to_numpy(), "kind": [s for _, s in some]})

    return _bounded(df, key, most).select(key, id_col, vector_col, fixed_col).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, kind string")


def session_memberships(df: DataFrame, keys: list[str], measures: list[str], buckets: int) -> DataFrame:
    """df with an array of weights for each measure: its rank within the session on neighbouring buckets; NULL measures belong to none."""
    for m in measures:
        there = F.col(m).isNotNull()
        n = F.sum(there.cast("int")).over(Window.partitionBy(*keys))
        rank = (C.midrank([*keys, there], m) - 0.5) / n
        df = df.withColumn(f"{m}_weights", F.when(there, C.fuzzy_buckets(rank, buckets)).otherwise(F.array_repeat(F.lit(0.0), buckets)))
    return df
