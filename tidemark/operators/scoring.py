"""Scores of a prediction panel by session, calls and abstentions, and labels that had matured by a decision.

A panel has a market, an instant, a target and a prediction; quantile columns stand beside them. Session
scores are sums over rows first, so that partial aggregation does the work and windows are needed for ranks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C

#: Figures closer to zero than this many digits count as zero.
DIGITS = 6


def sign(value: Column) -> Column:
    return F.signum(F.round(value, DIGITS))


def pinball(level: float, target: Column, quantile: Column) -> Column:
    return F.greatest(level * (target - quantile), (level - 1) * (target - quantile))


def covered(target: Column, low: Column, high: Column) -> Column:
    """1 if the target lies in the interval, edges included."""
    return ((F.round(target - low, 9) >= 0) & (F.round(high - target, 9) >= 0)).cast("double")


def interval_score(target: Column, low: Column, high: Column, alpha: float) -> Column:
    return high - low + F.when(target < low, 2 / alpha * (low - target)).when(target > high, 2 / alpha * (target - high)).otherwise(0.0)


def session_scores(df: DataFrame, keys: list[str], target: str, prediction: str, levels: list[float], quantiles: list[str], minimum: int = 3, digits: int = 9) -> DataFrame:
    """Every score of a session: errors, direction counts, rank correlation with its status, pinball losses, intervals, the up probability's Brier score."""
    y, p = F.col(target), F.col(prediction)
    q = [F.col(c) for c in quantiles]
    hit = sign(y) * sign(p)
    pairs = [(levels[i], levels[-1 - i], q[i], q[-1 - i]) for i in range(len(levels) // 2)]
    up = C.implied_up_probability(levels, q)
    r = df.withColumn("_rx", C.midrank(keys, prediction)).withColumn("_ry", C.midrank(keys, target))
    # ranks are centred by their known mean, so that no second pass over the session is needed
    middle = (F.count(F.lit(1)) + 1) / 2.0
    spread = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.count(F.lit(1)) * middle * middle
    mean = lambda x, name: F.round(F.avg(x), digits).alias(name)
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.abs(y - p), "mae"),
        mean((y - p) * (y - p), "mse"),
        F.count_if(hit > 0).alias("hits"),
        F.count_if(hit < 0).alias("misses"),
        F.count_if(hit == 0).alias("zeros"),
        F.count_if((sign(y) > 0) & (sign(p) > 0)).alias("up_hits"),
        F.count_if((sign(y) < 0) & (sign(p) < 0)).alias("down_hits"),
        *[mean(pinball(level, y, c), f"pinball_{i}") for i, (level, c) in enumerate(zip(levels, q, strict=True))],
        *[mean(covered(y, low, high), f"coverage_{i}") for i, (_, _, low, high) in enumerate(pairs)],
        *[mean(high - low, f"width_{i}") for i, (_, _, low, high) in enumerate(pairs)],
        *[mean(interval_score(y, low, high, 1 - (b - a)), f"interval_{i}") for i, (a, b, low, high) in enumerate(pairs)],
        F.round(F.avg(F.when(sign(y) != 0, F.pow(up - (sign(y) > 0).cast("double"), 2))), 7).alias("brier"),
        spread("_rx", "_rx").alias("_xx"),
        spread("_ry", "_ry").alias("_yy"),
        spread("_rx", "_ry").alias("_xy"),
    )
    flat = lambda c: F.col(c) < 1e-9
    status = F.when(F.col("n") < minimum, "too_few").when(flat("_xx") & flat("_yy"), "both_constant").when(flat("_xx"), "x_constant").when(flat("_yy"), "y_constant").otherwise("defined")
    s = s.withColumn("status", status).withColumn("rank_ic", F.when(F.col("status") == "defined", F.round(F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")), digits)))
    return s.drop("_xx", "_yy", "_xy")


def reliability_bins(df: DataFrame, keys: list[str], probability: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """Per key and bin of the probability: rows, sum of probabilities and of outcomes, which add up over sessions."""
    number = F.least(F.floor(F.round(probability * bins, 9)), F.lit(bins - 1)).cast("int")
    rows = df.select(*keys, number.alias("bin"), probability.alias("_p"), outcome.cast("double").alias("_o")).where("_o is not null and _p is not null")
    return rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_p"), 7).alias("probability"), F.sum("_o").alias("outcomes"))


def matched(df: DataFrame, keys: list[str], chosen: Column, eligible: Column, score: str, order: list[str], name: str) -> DataFrame:
    """df with `name`: as many eligible rows of each session as `chosen` marks, by falling score; rows without a score come last."""
    window = Window.partitionBy(*keys)
    wanted = F.sum(F.when(chosen & eligible, 1).otherwise(0)).over(window)
    place = F.row_number().over(window.orderBy(eligible.desc(), F.desc_nulls_last(score), *order))
    return df.withColumn(name, eligible & (place <= wanted))


def trailing_mature(df: DataFrame, keys: list[str], at: str, matures: str, value: str, length: int, minimum: int, summary: str, name: str) -> DataFrame:
    """df with a summary of each key's last `length` values that had matured at the row's instant: the median, or the root mean square; NULL under `minimum` of them.

    Decisions and maturities of a key share one time axis: a value enters at its maturity (before the
    decisions of that instant), and the frame counts the entered values only.
    """
    side = df.select(*keys, F.col(matures).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType).alias("_row"))
    own = df.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"), F.struct(*df.columns).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side", "_v")
    both = side.where(F.col(value).isNotNull() & F.col(matures).isNotNull()).unionByName(own).withColumn("_k", F.count("_v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the values carry their number, and a decision the number of values before it: its frame is the last `length` numbers
    recent = Window.partitionBy(*keys).orderBy("_k").rangeBetween(-(length - 1), 0)
    found = F.percentile("_v", 0.5).over(recent) if summary == "median" else F.sqrt(F.avg(F.col("_v") * F.col("_v")).over(recent))
    both = both.withColumn("_n", F.count("_v").over(recent)).withColumn("_s", found).where("_side = 1")
    return both.select("_row.*", F.when(F.col("_n") >= minimum, F.col("_s")).alias(name))


#: Declared metrics: a pattern of names, and the column that a name stands for.
METRICS = {
    r"mae": lambda y, p: F.avg(F.abs(y - p)),
    r"rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    r"bias": lambda y, p: F.avg(p - y),
    r"hit_rate": lambda y, p: F.avg(F.when(sign(y) * sign(p) != 0, (sign(y) == sign(p)).cast("double"))),
    r"pinball_(\d+)": lambda y, p, percent: F.avg(pinball(int(percent) / 100, y, p)),
    r"within_(\d+)": lambda y, p, thousandths: F.avg((F.round(F.abs(y - p), 9) <= int(thousandths) / 1000).cast("double")),
}


def metric(name: str, target: Column, prediction: Column) -> Column:
    """The declared metric of that name; an undeclared one is an error."""
    import re

    for pattern, rule in METRICS.items():
        found = re.fullmatch(pattern, name)
        if found:
            return rule(target, prediction, *found.groups()).alias(name)
    raise KeyError(f"undeclared metric {name!r}")


def reconstructed(df: DataFrame, keys: list[str], names: list[str], target: str, prediction: str, digits: int = 9) -> DataFrame:
    """(keys, metric, value): every named metric computed again from the rows."""
    wide = df.groupBy(*keys).agg(*[metric(n, F.col(target), F.col(prediction)) for n in names])
    return wide.unpivot(keys, names, "metric", "value").withColumn("value", F.round("value", digits))


def check_summary(published: DataFrame, expected: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Per metric: values that agree, differ, are undeclared (published only) or unpublished (expected only)."""
    a = published.select(*keys, "metric", F.col("value").alias("_a"), F.lit(True).alias("_left"))
    b = expected.select(*keys, "metric", F.col("value").alias("_b"), F.lit(True).alias("_right"))
    same = F.col("_a").eqNullSafe(F.col("_b")) | (F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    state = F.when(F.col("_right").isNull(), "undeclared").when(F.col("_left").isNull(), "unpublished").when(same, "agrees").otherwise("differs")
    return a.join(b, [*keys, "metric"], "full").groupBy("metric", state.alias("state")).agg(F.count(F.lit(1)).alias("values"))
