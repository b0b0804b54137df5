"""Joins by time, revisions, grids, ranks and samples as DataFrame operators.

Every operator partitions by the caller's keys; none needs a global window. Names that an operator
adds inside begin with an underscore and two letters of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Refused(ValueError):
    """An input breaks a declared rule; nothing is repaired."""


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or Refused if a key occurs twice."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise Refused(f"repeated key {keys}")
    return df


def require_columns(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """df, or Refused unless it has exactly the declared columns and types."""
    if dict(df.dtypes) != declared or len(df.columns) != len(declared):
        raise Refused(f"columns are {df.dtypes}")
    return df


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], prefix: str = "") -> DataFrame:
    """left with the values of the latest right row at or before its time; a NULL latest value stays NULL.

    One union and one sort by key and time instead of a range join; the right side comes first at equal times.
    """
    mark = F.struct(F.col(on).alias("at"), *[F.col(v) for v in values])
    a = left.select(*by, F.col(on), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_seen"))
    b = right.select(*by, F.col(on), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), mark.alias("_seen"))
    order = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_seen", F.last("_seen", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_row.*", F.col("_seen.at").alias(f"{prefix}at"), *[F.col(f"_seen.{v}").alias(f"{prefix}{v}") for v in values])


def latest_revision(facts: DataFrame, keys: list[str], order: list[str], value: str, cutoff: Column) -> DataFrame:
    """The value of each key's latest row for which the cutoff holds; keys whose latest rows disagree are left out."""
    place = F.struct(*order)
    top = facts.where(cutoff).groupBy(*keys, *order).agg(F.countDistinct(value).alias("_kinds"), F.max(value).alias(value))
    return top.groupBy(*keys).agg(F.max_by(F.struct(value, "_kinds"), place).alias("_top"), *[F.max_by(c, place).alias(c) for c in order]).where("_top._kinds = 1").select(*keys, *order, F.col(f"_top.{value}").alias(value))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose right time is within `seconds` up to the left time.

    Times are dealt into buckets of that length; each left row meets two of them, so that the join stays an equi join.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", F.explode(F.array(bucket(left_time) - 1, bucket(left_time))))
    b = right.withColumn("_bucket", bucket(right_time))
    span = F.expr(f"interval {seconds} seconds")
    return a.join(b, [*by, "_bucket"]).where((F.col(right_time) > F.col(left_time) - span) & (F.col(right_time) <= F.col(left_time))).drop("_bucket")


def next_in_calendar(days: DataFrame, day: str, lag: int = 1) -> DataFrame:
    """Each day of a calendar with the day `lag` places later (NULL at the end).

    The calendar is one column of days: its places are numbered by month first, so that no task sorts all of it.
    """
    months = days.select(day).distinct().withColumn("_month", F.trunc(day, "MM"))
    sizes = months.groupBy("_month").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("a._month") > F.col("b._month"), "left").groupBy(F.col("a._month").alias("_month")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    placed = months.withColumn("_in", F.row_number().over(Window.partitionBy("_month").orderBy(day))).join(F.broadcast(before), "_month")  # a row for each month
    placed = placed.select(day, (F.col("_before") + F.col("_in")).alias("_place"))
    later = placed.select(F.col(day).alias(f"next_{day}"), (F.col("_place") - lag).alias("_place"))
    return placed.join(later, "_place", "left").select(day, f"next_{day}")


def dense_grid(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """rows on every day between the first and last of each key; absent days have NULL values."""
    grid = rows.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return grid.join(rows, [*keys, day], "left")


def last_valid(df: DataFrame, keys: list[str], order: str, value: str, tolerance: int, name: str) -> DataFrame:
    """df with the last non-NULL value of at most `tolerance` rows back."""
    window = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_place", F.row_number().over(window))
    seen = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col("_place").alias("p"), F.col(value).alias("v"))), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_seen", seen).withColumn(name, F.when(F.col("_place") - F.col("_seen.p") <= tolerance, F.col("_seen.v"))).drop("_place", "_seen")


def runs(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """df with the number of the run that each row is in; a run begins where `starts` holds."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, level: float, name: str) -> DataFrame:
    """Per key the smallest value at which the cumulative weight reaches `level` of the total."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    window = Window.partitionBy(*keys)
    sums = sums.withColumn("_sum", F.sum("_w").over(window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(window))
    return sums.where(F.col("_sum") >= F.col("_all") * level - 1e-12).groupBy(*keys).agg(F.min(value).alias(name))


#: Edges between which an order statistic is looked for.
EDGES = 64


def order_statistics(df: DataFrame, keys: list[str], value: str, places: list[tuple[int, Column]], name: str, label: str) -> DataFrame:
    """(keys, n, name, label): per key and labelled place the value at that place of its ascending order; a place may use _n, the key's rows. NULL values take no part.

    Equal values are counted where they are read. Approximate quantiles cut a key's values into buckets,
    whose counts tell the one that holds the place, and only that one is sorted: no task orders a whole key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, [k / EDGES for k in range(1, EDGES)], F.lit(10_000)).alias("_e"))
    cut = counts.join(cuts, keys).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    w = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    sums = sums.withColumn("_n", F.sum("_s").over(w)).withColumn("_before", F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"))
    wanted = sums.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias(label), place.cast("long").alias("_place")) for n, place in places])).alias("_w")).select(*keys, "_b", "_n", "_before", "_s", "_w.*")
    wanted = wanted.where((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_before") + F.col("_s")))
    inside = cut.join(wanted, [*keys, "_b"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, label).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_c") < F.col("_place")))
    return inside.select(*keys, F.col("_n").alias("n"), F.col(value).alias(name), label)


def order_statistic(df: DataFrame, keys: list[str], value: str, place: Column, name: str) -> DataFrame:
    """(keys, n, name): the value at one place of each key."""
    return order_statistics(df, keys, value, [(0, place)], name, "_label").drop("_label")


def session_correlation(df: DataFrame, keys: list[str], x: str, y: str, minimum: int) -> DataFrame:
    """Pearson correlation per key with its status; sums are centred first and nothing divides by zero."""
    window = Window.partitionBy(*keys)
    c = df.withColumn("_x", F.col(x) - F.avg(x).over(window)).withColumn("_y", F.col(y) - F.avg(y).over(window))
    sums = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.sum(F.col("_x") * F.col("_y")).alias("_xy"))
    status = F.when(F.col("n") < minimum, "too_few").when((F.col("_xx") < 1e-12) & (F.col("_yy") < 1e-12), "both_constant").when(F.col("_xx") < 1e-12, "x_constant").when(F.col("_yy") < 1e-12, "y_constant").otherwise("defined")
    return sums.withColumn("status", status).withColumn("correlation", F.when(F.col("status") == "defined", F.round(F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")), 9))).select(*keys, "n", "status", "correlation")


def hash_order(df: DataFrame, seed: str, key: str) -> Column:
    """A fixed pseudo-random order of a key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)


def keyset_page(df: DataFrame, keys: list[str], after: list, size: int) -> DataFrame:
    """The `size` rows that follow a key in key order."""
    last = F.struct(*[F.lit(v).cast(dict(df.dtypes)[k]).alias(k) for k, v in zip(keys, after, strict=True)])
    return df.where(F.struct(*keys) > last).orderBy(*keys).limit(size)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: each key's state is left_only, right_only, equal or changed (NULLs are equal)."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    state = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("changed")
    return a.join(b, keys, "full").withColumn("state", state).drop("_a", "_b")


def conflicting_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per repeated key: rows, distinct values, and whether they conflict."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(value).alias("kinds")).where("rows > 1").withColumn("conflict", F.col("kinds") > 1)


def suffix_product(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The product of the values strictly after each row: a running product from the key's end."""
    later = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.product(value).over(later), F.lit(1.0)))


def running_drawdown(df: DataFrame, keys: list[str], order: str, log_return: str) -> DataFrame:
    """Per key: cumulative return, volatility and maximum drawdown from the running peak (initial capital included)."""
    path = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_cum", F.sum(log_return).over(path))
    df = df.withColumn("_peak", F.greatest(F.max("_cum").over(path), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.expm1(F.sum(log_return)), 9).alias("cumulative"), F.round(F.stddev_samp(log_return), 9).alias("volatility"), F.round(F.max(1 - F.exp(F.col("_cum") - F.col("_peak"))), 9).alias("max_drawdown"))


def tail_weights(df: DataFrame, keys: list[str], score: str, percent: int) -> DataFrame:
    """df with side +1 for the top and -1 for the bottom floor(percent) of each key; ties across the boundary belong to neither."""
    window = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(window)
    k = F.floor(n * percent / F.lit(100.0))
    above = F.count(F.lit(1)).over(window.orderBy(score).rangeBetween(0, Window.unboundedFollowing))
    below = F.count(F.lit(1)).over(window.orderBy(score).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("side", F.when(above <= k, 1).when(below <= k, -1).otherwise(0))
