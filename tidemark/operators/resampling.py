"""Resampled statistics over series that are already one value a session: draw tables, replicates, families, contrasts, attributions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def placed(series: DataFrame, keys: list[str], order: str) -> DataFrame:
    """series with its place from 0 in each key's order, and the key's length."""
    w = Window.partitionBy(*keys)
    return series.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("length", F.count(F.lit(1)).over(w))


def circular_draws(sizes: DataFrame, keys: list[str], length: str, replicates: int, block: int, start: Column) -> DataFrame:
    """(keys, replicate, at, place): each replicate's places, blocks of consecutive ones modulo the length, cut to the length.

    `start` is a column of replicate and number that gives a block's first place before the modulo; the draws are a
    table, so that every statistic and every arm uses the same ones.
    """
    d = sizes.select(*keys, length, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    d = d.withColumn("number", F.explode(F.sequence(F.lit(0), F.floor((F.col(length) - 1) / block).cast("int"))))
    d = d.withColumn("_start", F.pmod(start, F.col(length))).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    d = d.withColumn("at", F.col("number") * block + F.col("_step")).where(F.col("at") < F.col(length))
    return d.select(*keys, "replicate", "at", F.pmod(F.col("_start") + F.col("_step"), F.col(length)).cast("int").alias("place"))


def step_down(estimates: DataFrame, draws: DataFrame, member: str, replicate: str, value: str, level: float) -> DataFrame:
    """Per member its estimate, deviation over the replicates, simultaneous interval and step-down adjusted p-value.

    Statistics are studentised; the interval's width comes from the replicates' largest deviation, the
    p-value of the k-th largest statistic from the replicates' largest among itself and those below it.
    """
    spread = draws.groupBy(member).agg(F.stddev_samp(value).alias("deviation"))
    e = estimates.join(spread, member).withColumn("statistic", F.when(F.col("deviation") > 0, F.abs(F.col("estimate")) / F.col("deviation")))
    one = Window.partitionBy(F.lit(0))  # one row for each member of a declared family
    e = e.withColumn("rank", F.row_number().over(one.orderBy(F.desc_nulls_last("statistic"), member)))
    t = draws.join(F.broadcast(e.select(member, "estimate", "deviation", "rank")), member)
    t = t.withColumn("_t", F.when(F.col("deviation") > 0, F.abs(F.col(value) - F.col("estimate")) / F.col("deviation")))
    below = Window.partitionBy(replicate).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("_most", F.max("_t").over(below))
    width = t.where("rank = 1").agg(F.percentile("_most", level).alias("width"))
    p = t.join(F.broadcast(e.select(member, "statistic")), member).groupBy(member).agg(((1 + F.count_if(F.col("_most") >= F.col("statistic"))) / (1 + F.count(F.lit(1)))).alias("_p"))
    e = e.join(p, member).crossJoin(F.broadcast(width))
    adjusted = F.max("_p").over(one.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return e.select(member, "estimate", "deviation", "rank", (F.col("estimate") - F.col("width") * F.col("deviation")).alias("low"), (F.col("estimate") + F.col("width") * F.col("deviation")).alias("high"), adjusted.alias("p_value"))


def path_statistics(returns: DataFrame, keys: list[str], order: str, value: str, per_year: int) -> DataFrame:
    """Of each path of log returns: cumulative and annualised return, volatility, Sharpe and Sortino ratios, maximum drawdown from the running peak."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = returns.withColumn("_cum", F.sum(value).over(w))
    r = r.withColumn("_peak", F.greatest(F.max("_cum").over(w), F.lit(0.0)))
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("_sum"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"),
        F.sqrt(F.avg(F.when(F.col(value) < 0, F.col(value) * F.col(value)).otherwise(0.0))).alias("_down"), F.max(1 - F.exp(F.col("_cum") - F.col("_peak"))).alias("max_drawdown"),
    )
    year = float(per_year)
    ratio = lambda below: F.when(F.col(below) > 0, F.col("_mean") / F.col(below) * year**0.5)
    return s.select(*keys, "n", F.expm1("_sum").alias("cumulative"), F.expm1(F.col("_sum") * year / F.col("n")).alias("annual"), (F.col("_sd") * year**0.5).alias("volatility"), ratio("_sd").alias("sharpe"), ratio("_down").alias("sortino"), "max_drawdown")


def contrasts(values: DataFrame, keys: list[str], arm: str, value: str, coefficients: DataFrame) -> DataFrame:
    """(keys, contrast, value): declared sums of arms; a contrast with an absent arm is NULL. coefficients: contrast, arm, coefficient."""
    need = coefficients.groupBy("contrast").agg(F.count(F.lit(1)).alias("_need"))
    j = values.join(F.broadcast(coefficients.withColumnRenamed("arm", arm)), arm)  # a declared family
    s = j.groupBy(*keys, "contrast").agg(F.sum(F.col("coefficient") * F.col(value)).alias("_s"), F.count(value).alias("_n"))
    return s.join(F.broadcast(need), "contrast").select(*keys, "contrast", F.when(F.col("_n") == F.col("_need"), F.col("_s")).alias("value"))


def shapley_weights(components: list[str]) -> list[tuple[str, str, float]]:
    """(component, coalition, weight): the coalition's worth counts with that weight; coalitions are sorted names joined by +, "" the empty one."""
    n, out = len(components), []
    for c in components:
        others = [x for x in components if x != c]
        for k in range(n):
            for some in combinations(others, k):
                w = factorial(k) * factorial(n - k - 1) / factorial(n)
                out.append((c, "+".join(sorted([*some, c])), w))
                out.append((c, "+".join(sorted(some)), -w))
    return out


def factorial_effects(components: list[str]) -> list[tuple[str, str, float]]:
    """(effect, coalition, coefficient) of every main effect and interaction of a full two-level design."""
    n, out = len(components), []
    subsets = [s for k in range(n + 1) for s in combinations(components, k)]
    for effect in subsets[1:]:
        for s in subsets:
            sign = 1
            for c in effect:
                sign *= 1 if c in s else -1
            out.append((":".join(effect), "+".join(sorted(s)), sign / 2 ** (n - 1)))
    return out


def decision(kind: str, low: Column, high: Column, band: Column, keep: float, abandon: float) -> Column:
    """What an interval and a band of seed variance say of a variant whose smaller losses are negative.

    not_interpretable: no interval, or one that the seeds' band alone could make; else by `kind`: superiority
    (keep below -keep, abandon above 0), non_inferiority (keep below keep, abandon above abandon) or
    equivalence (keep within +-keep, abandon wholly outside); undecided otherwise.
    """
    rules = {
        "superiority": (high < -keep, low > 0),
        "non_inferiority": (high < keep, low > abandon),
        "equivalence": ((low > -keep) & (high < keep), (low > keep) | (high < -keep)),
    }
    good, bad = rules[kind]
    broken = low.isNull() | high.isNull() | (high < low) | band.isNull() | (high - low < band)
    return F.when(broken, "not_interpretable").when(good, "keep").when(bad, "abandon").otherwise("undecided")
