"""Samples of a decision from four modalities: a price window, news of a window, the latest facts and a chart, with the context known by then.

Every modality is known by an availability; a decision becomes a sample where all that are required have
something by its instant. The joins are equi joins on the asset with a bounded expansion by days, so that
none of them is a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.relational import asof_join


def windows(prices: DataFrame, asset: str, day: str, columns: list[str], length: int, least: int) -> DataFrame:
    """Per asset and session the window of its last `length` calendar days, where at least `least` of them are there: asset, day, window, present."""
    place = F.unix_date(day)
    w = Window.partitionBy(asset).orderBy("_place").rangeBetween(-(length - 1), 0)
    p = prices.withColumn("_place", place).withColumn("window", F.collect_list(F.struct(F.col(day).alias("day"), *columns)).over(w))
    return p.where(F.size("window") >= least).select(asset, day, "window", F.size("window").alias("present"))


def news_of(decisions: DataFrame, news: DataFrame, asset: str, at: str, available: str, days: int, values: list[Column]) -> DataFrame:
    """(asset, at, values): aggregates of the news of the `days` days up to each decision; decisions without news have no row."""
    d = decisions.select(asset, at, F.explode(F.sequence(F.date_sub(F.col(at).cast("date"), days), F.col(at).cast("date"))).alias("_day"))
    n = news.withColumn("_day", F.col(available).cast("date"))
    j = d.join(n, [asset, "_day"]).where((F.col(available) <= F.col(at)) & (F.col(available) > F.col(at) - F.make_dt_interval(F.lit(days))))
    return j.groupBy(asset, at).agg(*values)


def materialised(prices: DataFrame, news: DataFrame, facts: DataFrame, charts: DataFrame, context: DataFrame, asset: str, at: str, required: list[str]) -> DataFrame:
    """One row a decision with its four modalities, the context as of it, and `absent`: the required modalities that it lacks.

    prices: asset, at, ...; news: asset, at, ...; charts: asset, at, ...; facts: asset, at (availability), ...;
    context: at (availability), ...: the same for all assets. A sample is a row with nothing absent.
    """
    names = {"news": news, "charts": charts}
    j = prices
    for name, df in names.items():
        j = j.join(df.select(asset, at, F.struct(*[c for c in df.columns if c not in (asset, at)]).alias(name)), [asset, at], "left")
    values = [c for c in facts.columns if c not in (asset, at)]
    j = asof_join(j, facts, at, [asset], values, "fact_")
    j = j.withColumn("facts", F.when(F.col("fact_at").isNotNull(), F.struct("fact_at", *[f"fact_{v}" for v in values]))).drop("fact_at", *[f"fact_{v}" for v in values])
    # the context is one series: its instants are few, and each decision instant looks it up once
    known = context.columns
    instants = j.select(at).distinct().withColumn("_one", F.lit(1))
    found = asof_join(instants, context.withColumn("_one", F.lit(1)), at, ["_one"], [c for c in known if c != at], "context_").drop("_one", "context_at")
    j = j.join(found, at)
    lacking = F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in required]), lambda x: x.isNotNull())
    return j.withColumn("absent", lacking)
