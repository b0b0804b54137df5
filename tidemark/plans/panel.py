"""Queries over a forecast panel derived from lineitem.

market is l_returnflag, session the day of l_shipdate, asset (l_orderkey, l_linenumber);
target = l_discount - 0.05 and prediction = l_tax - 0.04.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import relational as R
from tidemark.operators.catalogs import bottom_k
from tidemark.session import table


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("market"),
        F.col("l_shipdate").cast("date").alias("session"),
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") - 0.05).alias("target"),
        (F.col("l_tax") - 0.04).alias("prediction"),
    )


PANEL_SQL = """panel AS (
  SELECT l_returnflag AS market, CAST(l_shipdate AS DATE) AS session, l_orderkey, l_linenumber,
         l_discount - 0.05 AS target, l_tax - 0.04 AS prediction FROM lineitem)"""


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE, MSE and sign counts of every (market, session)."""
    hit = F.signum(F.round("target", 6)) * F.signum(F.round("prediction", 6))
    return (
        panel(spark, sf_dir)
        .groupBy("market", "session")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.abs(F.col("target") - F.col("prediction"))), 9).alias("mae"),
            F.round(F.avg(F.pow(F.col("target") - F.col("prediction"), 2)), 9).alias("mse"),
            F.count_if(hit > 0).alias("hits"),
            F.count_if(hit < 0).alias("misses"),
            F.count_if(hit == 0).alias("zeros"),
        )
    )



KEYS = ["market", "session"]


def session_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of prediction and target per session, with its status."""
    ranked = panel(spark, sf_dir).withColumn("rt", C.midrank(KEYS, "target")).withColumn("rp", C.midrank(KEYS, "prediction"))
    return R.session_correlation(ranked, KEYS, "rp", "rt", 3).withColumnRenamed("correlation", "rank_ic")


def _session_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("mae"))


def session_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market: the mean over sessions and the mean over rows; in all: the mean of markets' means."""
    by_market = _session_mae(spark, sf_dir).groupBy("market").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("mae"), 9).alias("session_mean"), F.round(F.sum(F.col("mae") * F.col("n")) / F.sum("n"), 9).alias("row_mean"))
    total = by_market.agg(F.lit("all").alias("market"), F.sum("sessions").alias("sessions"), F.round(F.avg("session_mean"), 8).alias("session_mean"), F.round(F.avg("row_mean"), 8).alias("row_mean"))
    return by_market.unionByName(total)


def selective_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign hits among the ceil(c n) rows of a session with the largest predictions, for three coverages."""
    window = Window.partitionBy(*KEYS)
    rows = panel(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(window)).withColumn("r", F.row_number().over(window.orderBy(F.desc(F.round(F.abs("prediction"), 6)), "l_orderkey", "l_linenumber")))
    rows = rows.withColumn("coverage", F.explode(F.array(*map(F.lit, (10, 25, 50))))).where(F.col("r") * 100 < F.col("n") * F.col("coverage") + 100)
    hit = F.signum(F.round("target", 6)) * F.signum(F.round("prediction", 6))
    return rows.groupBy("market", "coverage").agg(F.count(F.lit(1)).alias("taken"), F.count_if(hit > 0).alias("hits"), F.count_if(hit < 0).alias("misses"))


LEVELS = (0.025, 0.1, 0.5, 0.9, 0.975)
WIDTHS = (-0.06, -0.03, 0.0, 0.03, 0.06)


def pinball_interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinball loss of five quantiles (prediction and fixed widths), coverage and interval scores per market."""
    q = [F.col("prediction") + w for w in WIDTHS]
    loss = [F.greatest(level * (F.col("target") - x), (level - 1) * (F.col("target") - x)) for level, x in zip(LEVELS, q, strict=True)]

    def interval(lo, hi, alpha):
        y = F.col("target")
        return hi - lo + F.when(y < lo, 2 / alpha * (lo - y)).when(y > hi, 2 / alpha * (y - hi)).otherwise(0.0)

    inside = lambda lo, hi: F.avg(((F.round(F.col("target") - lo, 9) >= 0) & (F.round(hi - F.col("target"), 9) >= 0)).cast("double"))
    return panel(spark, sf_dir).groupBy("market").agg(
        *[F.round(F.avg(x), 9).alias(f"pinball_{k}") for k, x in enumerate(loss)],
        F.round(inside(q[0], q[4]), 9).alias("coverage_95"),
        F.round(inside(q[1], q[3]), 9).alias("coverage_80"),
        F.round(F.avg(interval(q[0], q[4], 0.05)), 9).alias("score_95"),
        F.round(F.avg(interval(q[1], q[3], 0.2)), 9).alias("score_80"),
        F.round(F.avg(C.implied_up_probability(list(LEVELS), q)), 7).alias("up_probability"),
    )


def cross_section_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midranks of the prediction within its session, scaled to [-1, 1]."""
    return panel(spark, sf_dir).select("market", "session", "l_orderkey", "l_linenumber", F.round(C.scaled_midrank(KEYS, "prediction"), 9).alias("scaled_rank"))


def long_short_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the quartile book of each session: sides by the tie rule, equal weights within a side."""
    rows = R.tail_weights(panel(spark, sf_dir).withColumn("score", F.round("prediction", 6)), KEYS, "score", 25)
    book = rows.groupBy(*KEYS).agg(F.count_if(F.col("side") > 0).alias("longs"), F.count_if(F.col("side") < 0).alias("shorts"), F.sum(F.when(F.col("side") > 0, F.col("target"))).alias("up"), F.sum(F.when(F.col("side") < 0, F.col("target"))).alias("down"))
    return book.where("longs > 0 and shorts > 0").select(*KEYS, "longs", "shorts", F.round(F.col("up") / F.col("longs") - F.col("down") / F.col("shorts"), 9).alias("gross"))


def conformal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market the order statistics of the absolute error at k = ceil((n + 1) level) for 80 and 95 percent."""
    rows = panel(spark, sf_dir).withColumn("error", F.round(F.abs(F.col("target") - F.col("prediction")), 9))
    return R.order_statistics(rows, ["market"], "error", [(level, C.ceil_percent(F.col("_n") + 1, level)) for level in (80, 95)], "radius", "level")


def conformal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested intervals from each market's radii, and their coverage and width."""
    radii = conformal_fit(spark, sf_dir).groupBy("market").pivot("level", [80, 95]).agg(F.first("radius"))
    rows = panel(spark, sf_dir).join(F.broadcast(radii), "market")  # a row for each market
    pairs = C.narrow_widen(F.col("prediction"), [F.col("80"), F.col("95")])
    inside = lambda p: F.avg(((F.round(F.col("target") - p[0], 9) >= 0) & (F.round(p[1] - F.col("target"), 9) >= 0)).cast("double"))
    return rows.groupBy("market").agg(F.round(inside(pairs[0]), 9).alias("coverage_80"), F.round(inside(pairs[1]), 9).alias("coverage_95"), F.round(F.avg(pairs[1][1] - pairs[1][0]), 9).alias("width_95"))


def weighted_median_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor in [0, 1] that minimises the weighted sum of |target - factor * prediction|, each session weighing one."""
    rows = panel(spark, sf_dir).withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).where(F.round(F.abs("prediction"), 6) > 0)
    rows = rows.select("market", F.round(F.col("target") / F.col("prediction"), 6).alias("ratio"), (F.col("w") * F.abs("prediction")).alias("weight"))
    found = R.weighted_quantile(rows, ["market"], "ratio", "weight", 0.5, "median")
    return found.select("market", F.round(F.least(F.greatest("median", F.lit(0.0)), F.lit(1.0)), 6).alias("factor"))


def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets standardised within their session, sessions without spread or with one row not kept."""
    w = Window.partitionBy(*KEYS)
    rows = panel(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("m", F.avg("target").over(w)).withColumn("s", F.stddev_samp("target").over(w))
    kept = (F.col("n") >= 2) & (F.col("s") > 1e-9)
    return rows.groupBy("market").agg(F.count_if(kept).alias("kept"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("left_out"), F.round(F.sum(F.when(kept, F.abs((F.col("target") - F.col("m")) / F.col("s")))), 5).alias("spread"))


def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way analysis of the error by session within each market: mean squares within and between, and the correlation they imply."""
    rows = panel(spark, sf_dir).withColumn("e", F.col("target") - F.col("prediction"))
    by = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("m"), F.var_pop("e").alias("v"))
    w = Window.partitionBy("market")
    by = by.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    parts = by.groupBy("market").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    msb, msw = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("rows") - F.col("k"))
    n0 = (F.col("rows") - F.col("squares") / F.col("rows")) / (F.col("k") - 1)
    share = F.greatest((msb - msw) / n0, F.lit(0.0))
    return parts.select("market", F.round(msb, 9).alias("between_ms"), F.round(msw, 9).alias("within_ms"), F.round(share / (share + msw), 7).alias("correlation"))


def daily_loss_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss per day of two models (the panel's prediction and zero), days with both only."""
    rows = panel(spark, sf_dir)
    long = rows.select("session", F.explode(F.map_from_arrays(F.array(F.lit("model"), F.lit("zero")), F.array(F.abs(F.col("target") - F.col("prediction")), F.abs("target")))).alias("name", "loss"))
    return long.groupBy("session").pivot("name", ["model", "zero"]).agg(F.round(F.avg("loss"), 9)).dropna()


def diebold_mariano_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily loss difference per market and its autocovariances up to lag 2."""
    day = panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.abs(F.col("target") - F.col("prediction")) - F.abs("target")).alias("d"))
    w = Window.partitionBy("market")
    day = day.withColumn("c", F.col("d") - F.avg("d").over(w))
    lagged = [F.lag("c", k).over(w.orderBy("session")).alias(f"c{k}") for k in (1, 2)]
    day = day.select("market", "d", "c", *lagged)
    return day.groupBy("market").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("d"), 9).alias("mean"), F.round(F.avg(F.col("c") * F.col("c")), 9).alias("g0"), *[F.round(F.sum(F.col("c") * F.col(f"c{k}")) / F.count(F.lit(1)), 9).alias(f"g{k}") for k in (1, 2)])


def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular block bootstrap of the mean daily error per market: blocks of 8 days, 20 replicates, starts from a fixed rule.

    Only the draws' counts meet the daily sums; rows are never resampled.
    """
    day = panel(spark, sf_dir).groupBy(*KEYS).agg(F.sum(F.abs(F.col("target") - F.col("prediction"))).alias("loss"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("market")
    day = day.withColumn("p", F.row_number().over(w.orderBy("session")) - 1)
    sizes = day.groupBy("market").agg(F.count(F.lit(1)).alias("days"))
    draws = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("days") / 8.0).cast("int") - 1)))
    start = F.pmod(F.col("replicate") * 7919 + F.col("block") * 104729 + F.col("replicate") * F.col("block") * 31, F.col("days"))
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(F.col("block") * 8 + F.col("k") < F.col("days")).select("market", "replicate", F.pmod(start + F.col("k"), F.col("days")).alias("p"))
    counts = draws.groupBy("market", "replicate", "p").agg(F.count(F.lit(1)).alias("times"))
    means = counts.join(day, ["market", "p"]).groupBy("market", "replicate").agg((F.sum(F.col("times") * F.col("loss")) / F.sum(F.col("times") * F.col("n"))).alias("m"))
    return means.groupBy("market").agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.percentile("m", 0.025), 8).alias("low"), F.round(F.percentile("m", 0.975), 8).alias("high"))


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to folds by date, with a purge of labels that mature after the fold begins and an account of every exclusion."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("at")).withColumn("matures", F.date_add("at", 30))
    state = (
        F.when(F.col("at") >= F.lit("2001-01-01").cast("date"), "reserved")
        .when(F.col("at") >= F.lit("2000-01-01").cast("date"), F.when(F.col("matures") < F.lit("2001-01-01").cast("date"), "test").otherwise("test_purged"))
        .when(F.col("at") >= F.lit("1999-01-01").cast("date"), F.when(F.col("matures") < F.lit("2000-01-01").cast("date"), "validation").otherwise("validation_purged"))
        .otherwise(F.when(F.col("matures") < F.lit("1999-01-01").cast("date"), "train").otherwise("train_purged"))
    )
    return o.groupBy(state.alias("fold")).agg(F.count(F.lit(1)).alias("orders"), F.min("at").alias("first"), F.max("at").alias("last"))


def exclusion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by year and exclusion reason; a row may have several reasons, and rows without any count as accepted."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), C.exclusion_reasons(("large_quantity", F.col("l_quantity") > 45), ("no_discount", F.round("l_discount", 6) == 0), ("high_tax", F.round("l_tax", 6) >= 0.08)).alias("reasons"))
    return rows.select("year", F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("accepted")))).alias("reason")).groupBy("year", "reason").agg(F.count(F.lit(1)).alias("rows"))


def row_identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a table's rows: repeated keys, values out of range or not finite, dates after the cut."""
    li = table(spark, sf_dir, "lineitem")
    keys = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") <= 0).alias("low"), F.count_if(~C.finite(F.col("l_extendedprice"))).alias("odd"), F.count_if(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("late"))
    return keys.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.sum("low").alias("out_of_range"), F.sum("odd").alias("not_finite"), F.sum("late").alias("after_cut"))


def leakage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute rank correlation per feature of a session's values with the target, and with the asset's target a row earlier."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("market"), F.col("l_shipdate").cast("date").alias("session"), "l_orderkey", "l_linenumber", (F.col("l_discount") - 0.05).alias("target"), "l_quantity", "l_extendedprice", "l_tax")
    li = li.withColumn("placebo", F.lag("target").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "session", "target")))
    # the targets' ranks don't depend on the feature; the placebo's rows are a part of their own
    li = li.withColumn("past", F.col("placebo").isNotNull()).withColumn("ry", C.midrank(KEYS, "target")).withColumn("py", C.midrank([*KEYS, "past"], "placebo"))
    long = li.unpivot([*KEYS, "past", "ry", "py"], ["l_quantity", "l_extendedprice", "l_tax"], "feature", "value")
    keys = ["feature", *KEYS]
    long = long.withColumn("rx", C.midrank(keys, "value")).withColumn("px", C.midrank([*keys, "past"], "value"))

    def side(x: str, y: str, here: Column, name: str) -> list[Column]:
        """Sums of the products of ranks that are centred by their known mean."""
        n = F.count_if(here)
        middle = (n + 1) / 2.0
        part = lambda a, b: F.sum(F.when(here, F.col(a) * F.col(b))) - n * middle * middle
        return [n.alias(f"{name}_n"), part(x, x).alias(f"{name}_xx"), part(y, y).alias(f"{name}_yy"), part(x, y).alias(f"{name}_xy")]

    s = long.groupBy(*keys).agg(*side("rx", "ry", F.lit(True), "target"), *side("px", "py", F.col("past"), "placebo"))
    corr = {n: F.when((F.col(f"{n}_n") >= 4) & (F.col(f"{n}_xx") > 1e-9) & (F.col(f"{n}_yy") > 1e-9), F.col(f"{n}_xy") / F.sqrt(F.col(f"{n}_xx") * F.col(f"{n}_yy"))) for n in ("target", "placebo")}
    found = s.groupBy("feature").agg(*[x for n, c in corr.items() for x in (F.count(c).alias(f"{n}_sessions"), F.round(F.avg(F.abs(c)), 7).alias(f"{n}_mean"))])
    return found.withColumn("flag", F.col("target_mean") > F.col("placebo_mean") + 0.1)


def extreme_row_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of the largest squared error per market and their share of the market's sum."""
    rows = panel(spark, sf_dir).withColumn("e", F.round(F.pow(F.col("target") - F.col("prediction"), 2), 12))
    total = rows.groupBy("market").agg(F.sum("e").alias("total"))
    order = ["l_orderkey", "l_linenumber", "session"]
    top = bottom_k(rows, ["market"], F.struct((-F.col("e")).alias("e"), *order), 5)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("e"), *order)))
    return top.join(F.broadcast(total), "market").select("market", "r", "l_orderkey", "l_linenumber", F.round(F.col("e") / F.col("total"), 9).alias("share"))


def ratio_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of an order's lines as they become known, one row for each change, with the status of the ratio."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_shipdate").cast("date").alias("at")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.sum("l_quantity").alias("shipped"))
    w = Window.partitionBy("l_orderkey").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    li = li.withColumn("r", F.sum("returned").over(w)).withColumn("s", F.sum("shipped").over(w))
    status = F.when(F.col("r").isNull(), "missing_component").when(F.col("s") == 0, "zero_denominator").otherwise("available")
    li = li.withColumn("status", status).withColumn("ratio", F.when(F.col("status") == "available", F.round(F.col("r") / F.col("s"), 9)))
    order = Window.partitionBy("l_orderkey").orderBy("at")
    now = F.struct("status", "ratio")
    li = li.withColumn("changed", ~now.eqNullSafe(F.lag(now).over(order)))
    return li.where("changed").groupBy("status").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum("ratio"), 5).alias("total"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five customers of each segment in a fixed pseudo-random order."""
    c = table(spark, sf_dir, "customer")
    h = R.hash_order(c, "17", "c_custkey")
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(h))
    return bottom_k(c, ["c_mktsegment"], h, 5).select("c_mktsegment", "c_custkey", r.alias("place"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 customers after (nation 5, key 100) in (nation, key) order."""
    return R.keyset_page(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey", "c_custkey"], [5, 100], 50)


def stratified_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment the customer of median balance, of the 90th percentile, and hash order up to six."""
    c = table(spark, sf_dir, "customer")
    w = Window.partitionBy("c_mktsegment")
    c = c.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("p", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")) - 1)
    first = F.when(F.col("p") == F.floor((F.col("n") - 1) / 2), 0).when(F.col("p") == F.floor((F.col("n") - 1) * 9 / 10), 1).otherwise(2)
    c = c.withColumn("first", first).withColumn("r", F.row_number().over(w.orderBy("first", R.hash_order(c, "17", "c_custkey"))))
    return c.where("r <= 6").select("c_mktsegment", "c_custkey", "first", "r")


def fact_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's price of the latest order known by a cutoff; customers whose latest orders disagree are left out."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return R.latest_revision(o, ["o_custkey"], ["o_orderdate"], "o_totalprice", F.col("o_orderdate") <= F.lit("2000-06-30").cast("timestamp_ntz"))


def fact_dedup_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and day: repeated keys, and whether their prices conflict."""
    return R.conflicting_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], "o_totalprice")


def census_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and quantity by market and line state, with all subtotals."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("level"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority within status, with subtotals of the hierarchy only."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def next_session_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order day with the first later order day, and the one after that."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return R.next_in_calendar(days, "day").join(R.next_in_calendar(days, "day", 2).withColumnRenamed("next_day", "second_day"), "day")


def set_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with orders against days with shipments: in both, in one only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    parts = [("both", o.intersect(s)), ("orders_only", o.subtract(s)), ("shipments_only", s.subtract(o))]
    out = None
    for name, days in parts:
        part = days.agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("days"), F.min("day").alias("first"), F.max("day").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


def price_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices with limits of ten percent in decimals rounded half up, and to multiples of 0.05 half even."""
    p = table(spark, sf_dir, "part")
    x = F.col("p_retailprice").cast("decimal(18,2)")
    return p.select("p_partkey", C.half_up(x * F.lit("1.1").cast("decimal(3,1)")).cast("double").alias("upper"), C.half_up(x * F.lit("0.9").cast("decimal(3,1)")).cast("double").alias("lower"))


def selection_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by mean error, worst rank 1, with the gap to the best and the gain over the median."""
    m = _session_mae(spark, sf_dir).groupBy("market").agg(F.round(F.avg("mae"), 9).alias("mae"))
    s = m.agg(F.min("mae").alias("best"), F.percentile("mae", 0.5).alias("median"), F.count(F.lit(1)).alias("cases"), F.collect_list("mae").alias("all"))
    r = F.size(F.filter("all", lambda x: x > F.col("mae"))) + (F.size(F.filter("all", lambda x: x == F.col("mae"))) + 1) / 2.0
    return m.join(F.broadcast(s)).select("market", "mae", r.alias("rank"), F.round(F.col("mae") - F.col("best"), 9).alias("gap"), F.round(F.col("median") - F.col("mae"), 9).alias("gain"), "cases")


REGISTERED = {
    "session_metrics": (
        session_metrics,
        f"""
WITH {PANEL_SQL}, s AS (
  SELECT *, sign(round(target, 6)) * sign(round(prediction, 6)) AS hit FROM panel)
SELECT market, session, count(*) AS n, round(avg(abs(target - prediction)), 9) AS mae,
       round(avg(pow(target - prediction, 2)), 9) AS mse, count(*) FILTER (hit > 0) AS hits,
       count(*) FILTER (hit < 0) AS misses, count(*) FILTER (hit = 0) AS zeros
FROM s GROUP BY ALL""",
    ),
    "session_rank_ic": (
        session_rank_ic,
        f"""
WITH {PANEL_SQL}, r AS (
  SELECT market, session,
    rank() OVER (PARTITION BY market, session ORDER BY target) + (count(*) OVER (PARTITION BY market, session, target) - 1) / 2.0 AS y,
    rank() OVER (PARTITION BY market, session ORDER BY prediction) + (count(*) OVER (PARTITION BY market, session, prediction) - 1) / 2.0 AS x FROM panel),
c AS (SELECT market, session, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM r WINDOW w AS (PARTITION BY market, session)),
a AS (SELECT market, session, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM c GROUP BY ALL),
s AS (SELECT *, CASE WHEN n < 3 THEN 'too_few' WHEN xx < 1e-12 AND yy < 1e-12 THEN 'both_constant' WHEN xx < 1e-12 THEN 'x_constant' WHEN yy < 1e-12 THEN 'y_constant' ELSE 'defined' END AS status FROM a)
SELECT market, session, n, status, CASE WHEN status = 'defined' THEN round(xy / sqrt(xx * yy), 9) END AS rank_ic FROM s""",
    ),
    "session_weighted_mean": (
        session_weighted_mean,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, count(*) AS n, avg(abs(target - prediction)) AS mae FROM panel GROUP BY ALL),
m AS (SELECT market, count(*) AS sessions, round(avg(mae), 9) AS session_mean, round(sum(mae * n) / sum(n), 9) AS row_mean FROM s GROUP BY ALL)
SELECT * FROM m UNION ALL SELECT 'all', CAST(sum(sessions) AS BIGINT), round(avg(session_mean), 8), round(avg(row_mean), 8) FROM m""",
    ),
    "selective_hits": (
        selective_hits,
        f"""
WITH {PANEL_SQL}, r AS (
  SELECT *, count(*) OVER (PARTITION BY market, session) AS n,
    row_number() OVER (PARTITION BY market, session ORDER BY round(abs(prediction), 6) DESC, l_orderkey, l_linenumber) AS r,
    sign(round(target, 6)) * sign(round(prediction, 6)) AS hit FROM panel)
SELECT market, coverage, count(*) AS taken, count(*) FILTER (hit > 0) AS hits, count(*) FILTER (hit < 0) AS misses
FROM r, (VALUES (10), (25), (50)) v(coverage) WHERE r <= (n * coverage + 99) // 100 GROUP BY ALL""",
    ),
    "pinball_interval_scores": (
        pinball_interval_scores,
        f"""
WITH {PANEL_SQL}, q AS (SELECT market, target AS y, prediction - 0.06 AS a, prediction - 0.03 AS b, prediction AS c, prediction + 0.03 AS d, prediction + 0.06 AS e FROM panel)
SELECT market, round(avg(greatest(0.025 * (y - a), (0.025 - 1) * (y - a))), 9) AS pinball_0, round(avg(greatest(0.1 * (y - b), (0.1 - 1) * (y - b))), 9) AS pinball_1,
  round(avg(greatest(0.5 * (y - c), (0.5 - 1) * (y - c))), 9) AS pinball_2, round(avg(greatest(0.9 * (y - d), (0.9 - 1) * (y - d))), 9) AS pinball_3,
  round(avg(greatest(0.975 * (y - e), (0.975 - 1) * (y - e))), 9) AS pinball_4,
  round(avg(CASE WHEN round(y - a, 9) >= 0 AND round(e - y, 9) >= 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage_95,
  round(avg(CASE WHEN round(y - b, 9) >= 0 AND round(d - y, 9) >= 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage_80,
  round(avg(e - a + CASE WHEN y < a THEN 40 * (a - y) WHEN y > e THEN 40 * (y - e) ELSE 0 END), 9) AS score_95,
  round(avg(d - b + CASE WHEN y < b THEN 10 * (b - y) WHEN y > d THEN 10 * (y - d) ELSE 0 END), 9) AS score_80,
  round(avg(CASE WHEN a >= 0 THEN 0.975 WHEN b >= 0 THEN 1 - (0.025 + 0.075 * (-a / (b - a))) WHEN c >= 0 THEN 1 - (0.1 + 0.4 * (-b / (c - b)))
    WHEN d >= 0 THEN 1 - (0.5 + 0.4 * (-c / (d - c))) WHEN e >= 0 THEN 1 - (0.9 + 0.075 * (-d / (e - d))) ELSE 0.025 END), 7) AS up_probability
FROM q GROUP BY ALL""",
    ),
    "cross_section_ranks": (
        cross_section_ranks,
        f"""
WITH {PANEL_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY market, session) AS n,
  rank() OVER (PARTITION BY market, session ORDER BY prediction) + (count(*) OVER (PARTITION BY market, session, prediction) - 1) / 2.0 AS r FROM panel)
SELECT market, session, l_orderkey, l_linenumber, round(CASE WHEN n > 1 THEN 2.0 * (r - 1) / (n - 1) - 1 ELSE 0 END, 9) AS scaled_rank FROM r""",
    ),
    "long_short_book": (
        long_short_book,
        f"""
WITH {PANEL_SQL}, s AS (SELECT *, round(prediction, 6) AS score FROM panel),
c AS (SELECT *, count(*) OVER (PARTITION BY market, session) AS n,
  count(*) OVER (PARTITION BY market, session ORDER BY score RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
  count(*) OVER (PARTITION BY market, session ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM s),
k AS (SELECT *, CASE WHEN above <= n // 4 THEN 1 WHEN below <= n // 4 THEN -1 ELSE 0 END AS side FROM c),
b AS (SELECT market, session, count(*) FILTER (side > 0) AS longs, count(*) FILTER (side < 0) AS shorts, sum(target) FILTER (side > 0) AS up, sum(target) FILTER (side < 0) AS down FROM k GROUP BY ALL)
SELECT market, session, longs, shorts, round(up / longs - down / shorts, 9) + 0.0 AS gross FROM b WHERE longs > 0 AND shorts > 0""",
    ),
    "conformal_fit": (
        conformal_fit,
        f"""
WITH {PANEL_SQL}, e AS (SELECT market, round(abs(target - prediction), 9) AS error FROM panel),
r AS (SELECT market, error, row_number() OVER (PARTITION BY market ORDER BY error) AS r, count(*) OVER (PARTITION BY market) AS n FROM e)
SELECT market, n, error AS radius, level FROM r, (VALUES (80), (95)) v(level) WHERE r = ((n + 1) * level + 99) // 100""",
    ),
    "conformal_apply": (
        conformal_apply,
        f"""
WITH {PANEL_SQL}, e AS (SELECT market, round(abs(target - prediction), 9) AS error FROM panel),
r AS (SELECT market, error, row_number() OVER (PARTITION BY market ORDER BY error) AS r, count(*) OVER (PARTITION BY market) AS n FROM e),
f AS (SELECT market, max(error) FILTER (r = ((n + 1) * 80 + 99) // 100) AS a, max(error) FILTER (r = ((n + 1) * 95 + 99) // 100) AS b FROM r GROUP BY ALL)
SELECT market, round(avg(CASE WHEN round(target - (prediction - a), 9) >= 0 AND round(prediction + a - target, 9) >= 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage_80,
  round(avg(CASE WHEN round(target - (prediction - b), 9) >= 0 AND round(prediction + b - target, 9) >= 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage_95,
  round(avg(prediction + b - (prediction - b)), 9) AS width_95 FROM panel JOIN f USING (market) GROUP BY ALL""",
    ),
    "weighted_median_shrinkage": (
        weighted_median_shrinkage,
        f"""
WITH {PANEL_SQL}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY market, session) AS w FROM panel),
r AS (SELECT market, round(target / prediction, 6) AS ratio, sum(w * abs(prediction)) AS w FROM w WHERE round(abs(prediction), 6) > 0 GROUP BY ALL),
c AS (SELECT market, ratio, sum(w) OVER (PARTITION BY market ORDER BY ratio ROWS UNBOUNDED PRECEDING) AS s, sum(w) OVER (PARTITION BY market) AS t FROM r)
SELECT market, round(least(greatest(min(ratio), 0), 1), 6) + 0.0 AS factor FROM c WHERE s >= t * 0.5 - 1e-12 GROUP BY ALL""",
    ),
    "session_labels": (
        session_labels,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, target, count(*) OVER w AS n, avg(target) OVER w AS m, stddev_samp(target) OVER w AS s FROM panel WINDOW w AS (PARTITION BY market, session)),
k AS (SELECT *, coalesce(n >= 2 AND s > 1e-9, false) AS kept FROM s)
SELECT market, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS left_out, round(sum(abs((target - m) / s)) FILTER (kept), 5) AS spread FROM k GROUP BY ALL""",
    ),
    "variance_components": (
        variance_components,
        f"""
WITH {PANEL_SQL}, b AS (SELECT market, session, count(*) AS n, avg(target - prediction) AS m, var_pop(target - prediction) AS v FROM panel GROUP BY ALL),
g AS (SELECT *, sum(n * m) OVER (PARTITION BY market) / sum(n) OVER (PARTITION BY market) AS grand FROM b),
p AS (SELECT market, count(*) AS k, sum(n) AS rows, sum(n * n) AS squares, sum(n * pow(m - grand, 2)) AS between_s, sum(n * v) AS within_s FROM g GROUP BY ALL),
q AS (SELECT market, between_s / (k - 1) AS msb, within_s / (rows - k) AS msw, (rows - squares / rows) / (k - 1) AS n0 FROM p)
SELECT market, round(msb, 9) AS between_ms, round(msw, 9) AS within_ms, round(greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + msw), 7) AS correlation FROM q""",
    ),
    "daily_loss_matrix": (daily_loss_matrix, f"WITH {PANEL_SQL} SELECT session, round(avg(abs(target - prediction)), 9) AS model, round(avg(abs(target)), 9) AS zero FROM panel GROUP BY ALL"),
    "diebold_mariano_parts": (
        diebold_mariano_parts,
        f"""
WITH {PANEL_SQL}, d AS (SELECT market, session, avg(abs(target - prediction) - abs(target)) AS d FROM panel GROUP BY ALL),
c AS (SELECT market, session, d, d - avg(d) OVER (PARTITION BY market) AS c FROM d),
l AS (SELECT *, lag(c, 1) OVER (PARTITION BY market ORDER BY session) AS c1, lag(c, 2) OVER (PARTITION BY market ORDER BY session) AS c2 FROM c)
SELECT market, count(*) AS days, round(avg(d), 9) AS mean, round(avg(c * c), 9) AS g0, round(sum(c * c1) / count(*), 9) AS g1, round(sum(c * c2) / count(*), 9) AS g2 FROM l GROUP BY ALL""",
    ),
    "block_bootstrap": (
        block_bootstrap,
        f"""
WITH {PANEL_SQL}, d AS (SELECT market, session, sum(abs(target - prediction)) AS loss, count(*) AS n FROM panel GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY session) - 1 AS p FROM d),
s AS (SELECT market, count(*) AS days FROM d GROUP BY ALL),
b AS (SELECT market, days, r AS replicate, unnest(range(CAST(ceil(days / 8.0) AS BIGINT))) AS block FROM s, range(20) t(r)),
k AS (SELECT market, days, replicate, block, unnest(range(8)) AS k FROM b),
x AS (SELECT market, replicate, ((replicate * 7919 + block * 104729 + replicate * block * 31) % days + k) % days AS p, count(*) AS times FROM k WHERE block * 8 + k < days GROUP BY ALL),
m AS (SELECT market, replicate, sum(times * loss) / sum(times * n) AS m FROM x JOIN o USING (market, p) GROUP BY ALL)
SELECT market, round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m GROUP BY ALL""",
    ),
    "fold_assignment": (
        fold_assignment,
        """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS at_day, CAST(o_orderdate AS DATE) + 30 AS m FROM orders),
f AS (SELECT at_day, CASE WHEN at_day >= DATE '2001-01-01' THEN 'reserved'
  WHEN at_day >= DATE '2000-01-01' THEN CASE WHEN m < DATE '2001-01-01' THEN 'test' ELSE 'test_purged' END
  WHEN at_day >= DATE '1999-01-01' THEN CASE WHEN m < DATE '2000-01-01' THEN 'validation' ELSE 'validation_purged' END
  ELSE CASE WHEN m < DATE '1999-01-01' THEN 'train' ELSE 'train_purged' END END AS fold FROM o)
SELECT fold, count(*) AS orders, min(at_day) AS first, max(at_day) AS last FROM f GROUP BY ALL""",
    ),
    "exclusion_audit": (
        exclusion_audit,
        """
WITH r AS (SELECT year(l_shipdate) AS year, l_quantity > 45 AS a, round(l_discount, 6) = 0 AS b, round(l_tax, 6) >= 0.08 AS c FROM lineitem),
l AS (SELECT year, 'large_quantity' AS reason FROM r WHERE a UNION ALL SELECT year, 'no_discount' FROM r WHERE b UNION ALL SELECT year, 'high_tax' FROM r WHERE c
  UNION ALL SELECT year, 'accepted' FROM r WHERE NOT a AND NOT b AND NOT c)
SELECT CAST(year AS INTEGER) AS year, reason, count(*) AS rows FROM l GROUP BY ALL""",
    ),
    "row_identity_audit": (
        row_identity_audit,
        """
WITH k AS (SELECT count(*) AS n, count(*) FILTER (l_quantity <= 0) AS low, count(*) FILTER (l_extendedprice IS NULL OR NOT isfinite(l_extendedprice)) AS odd,
  count(*) FILTER (l_shipdate >= TIMESTAMP '2001-01-01') AS late FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS repeated_keys, CAST(sum(low) AS BIGINT) AS out_of_range, CAST(sum(odd) AS BIGINT) AS not_finite, CAST(sum(late) AS BIGINT) AS after_cut FROM k""",
    ),
    "leakage_scan": (
        leakage_scan,
        """
WITH l AS (SELECT l_returnflag AS market, CAST(l_shipdate AS DATE) AS session, l_orderkey, l_linenumber, l_discount - 0.05 AS target, l_quantity, l_extendedprice, l_tax FROM lineitem),
p AS (SELECT *, lag(target) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, session, target) AS placebo FROM l),
u AS (SELECT market, session, target, placebo, feature, value FROM p UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_tax))),
s AS (SELECT feature, market, session, value, target AS y, 't' AS side FROM u UNION ALL SELECT feature, market, session, value, placebo, 'p' FROM u WHERE placebo IS NOT NULL),
r AS (SELECT side, feature, market, session,
  rank() OVER (PARTITION BY side, feature, market, session ORDER BY value) + (count(*) OVER (PARTITION BY side, feature, market, session, value) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY side, feature, market, session ORDER BY y) + (count(*) OVER (PARTITION BY side, feature, market, session, y) - 1) / 2.0 AS y FROM s),
c AS (SELECT side, feature, market, session, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM r WINDOW w AS (PARTITION BY side, feature, market, session)),
k AS (SELECT side, feature, market, session, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 9) AS r FROM c GROUP BY ALL HAVING count(*) >= 4 AND sum(x * x) >= 1e-12 AND sum(y * y) >= 1e-12),
m AS (SELECT feature, count(*) FILTER (side = 't') AS target_sessions, round(avg(abs(r)) FILTER (side = 't'), 7) AS target_mean, count(*) FILTER (side = 'p') AS placebo_sessions, round(avg(abs(r)) FILTER (side = 'p'), 7) AS placebo_mean FROM k GROUP BY ALL)
SELECT feature, target_sessions, target_mean, placebo_sessions, placebo_mean, target_mean > placebo_mean + 0.1 AS flag FROM m""",
    ),
    "extreme_row_share": (
        extreme_row_share,
        f"""
WITH {PANEL_SQL}, e AS (SELECT *, round(pow(target - prediction, 2), 12) AS e FROM panel),
r AS (SELECT market, l_orderkey, l_linenumber, e, row_number() OVER (PARTITION BY market ORDER BY e DESC, l_orderkey, l_linenumber, session) AS r, sum(e) OVER (PARTITION BY market) AS t FROM e)
SELECT market, CAST(r AS INTEGER) AS r, l_orderkey, l_linenumber, round(e / t, 9) AS share FROM r WHERE r <= 5""",
    ),
    "ratio_derivation": (
        ratio_derivation,
        """
WITH d AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS t, sum(l_quantity) FILTER (l_returnflag = 'R') AS returned, sum(l_quantity) AS shipped FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, t, sum(returned) OVER w AS r, sum(shipped) OVER w AS s FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY t ROWS UNBOUNDED PRECEDING)),
u AS (SELECT l_orderkey, t, CASE WHEN r IS NULL THEN 'missing_component' WHEN s = 0 THEN 'zero_denominator' ELSE 'available' END AS status, CASE WHEN r IS NOT NULL AND s <> 0 THEN round(r / s, 9) END AS ratio FROM s),
c AS (SELECT *, lag(status) OVER w AS ps, lag(ratio) OVER w AS pr FROM u WINDOW w AS (PARTITION BY l_orderkey ORDER BY t))
SELECT status, count(*) AS changes, count(DISTINCT l_orderkey) AS orders, round(sum(ratio), 5) AS total FROM c WHERE ps IS NULL OR status <> ps OR ratio IS DISTINCT FROM pr GROUP BY ALL""",
    ),
    "hash_sample": (
        hash_sample,
        """
SELECT * FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('17:' || c_custkey)) AS INTEGER) AS place FROM customer) WHERE place <= 5""",
    ),
    "keyset_page": (keyset_page, "SELECT c_nationkey, c_custkey, c_name FROM customer WHERE (c_nationkey, c_custkey) > (5, 100) ORDER BY 1, 2 LIMIT 50"),
    "stratified_panel": (
        stratified_panel,
        """
WITH c AS (SELECT c_mktsegment, c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS p FROM customer),
f AS (SELECT *, CASE WHEN p = (n - 1) // 2 THEN 0 WHEN p = (n - 1) * 9 // 10 THEN 1 ELSE 2 END AS first FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY first, sha256('17:' || c_custkey)) AS INTEGER) AS r FROM f)
SELECT c_mktsegment, c_custkey, first, r FROM r WHERE r <= 6""",
    ),
    "fact_snapshot": (
        fact_snapshot,
        """
WITH o AS (SELECT o_custkey, o_orderdate, count(DISTINCT o_totalprice) AS k, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-30' GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM o)
SELECT o_custkey, o_orderdate, o_totalprice FROM t WHERE r = 1 AND k = 1""",
    ),
    "fact_dedup_ambiguity": (
        fact_dedup_ambiguity,
        "SELECT o_custkey, o_orderdate, count(*) AS rows, count(DISTINCT o_totalprice) AS kinds, count(DISTINCT o_totalprice) > 1 AS conflict FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "census_rollup": (
        census_rollup,
        "SELECT l_returnflag, l_linestatus, count(*) AS rows, sum(l_quantity) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
    "status_rollup": (status_rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "next_session_map": (
        next_session_map,
        "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, lead(day) OVER (ORDER BY day) AS next_day, lead(day, 2) OVER (ORDER BY day) AS second_day FROM d",
    ),
    "set_reconcile": (
        set_reconcile,
        """
WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
b AS (SELECT 'both' AS state, day FROM o WHERE day IN (FROM s) UNION ALL SELECT 'orders_only', day FROM o WHERE day NOT IN (FROM s) UNION ALL SELECT 'shipments_only', day FROM s WHERE day NOT IN (FROM o)),
n AS (SELECT * FROM (VALUES ('both'), ('orders_only'), ('shipments_only')) v(state))
SELECT n.state, count(day) AS days, min(day) AS first, max(day) AS last FROM n LEFT JOIN b USING (state) GROUP BY ALL""",
    ),
    "price_limits": (
        price_limits,
        "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 1.1::DECIMAL(3,1), 2) AS DOUBLE) AS upper, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 0.9::DECIMAL(3,1), 2) AS DOUBLE) AS lower FROM part",
    ),
    "selection_effect": (
        selection_effect,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(abs(target - prediction)) AS mae FROM panel GROUP BY ALL),
m AS (SELECT market, round(avg(mae), 9) AS mae FROM s GROUP BY ALL)
SELECT market, mae, rank() OVER (ORDER BY mae DESC) + (count(*) OVER (PARTITION BY mae) - 1) / 2.0 AS rank, round(mae - min(mae) OVER (), 9) AS gap, round(median(mae) OVER () - mae, 9) AS gain, count(*) OVER () AS cases FROM m""",
    ),
}
