"""Report compositions: books, controls, worlds, windows and populations put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import populations as P
from tidemark.operators import relational as R
from tidemark.plans.panel import KEYS, PANEL_SQL, panel
from tidemark.plans.prices import QUOTES, quotes
from tidemark.session import instants, table


def two_calendar_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each market's decisions on its own calendar (its next session) and their union: decisions aren't intersected."""
    p = panel(spark, sf_dir).where("l_linenumber <= 2")
    out = None
    for market, lag in (("A", 1), ("N", 2)):
        own = p.where(F.col("market") == market)
        days = own.select("session").distinct()
        part = own.join(F.broadcast(R.next_in_calendar(days, "session", lag)), "session")  # a row for each session
        out = part if out is None else out.unionByName(part)
    return out.groupBy("market", F.year("session").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.count("next_session").alias("labelled"), F.max(F.datediff("next_session", "session")).alias("longest"))


def compatible_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration and evaluation views joined in canonical order: whether they overlap, and the places where each begins."""
    p = panel(spark, sf_dir).select("market", "session").distinct()
    a, b = p.where("session < '1998-01-01'"), p.where("session >= '1997-12-01' and session < '1999-01-01'")
    both = a.withColumn("view", F.lit(0)).unionByName(b.withColumn("view", F.lit(1)))
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("market").orderBy("session", "view")) - 1)
    shared = F.count(F.lit(1)).over(Window.partitionBy("market", "session")) > 1
    return placed.withColumn("shared", shared).groupBy("market", "view").agg(F.count(F.lit(1)).alias("sessions"), F.min("place").alias("begins"), F.count_if("shared").alias("shared"))


def presence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation labels joined to samples by (asset, row position), whose days have to agree: presence patterns and disagreements."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("position", F.row_number().over(w) - 1).withColumn("day", F.col("ts").cast("date"))
    samples = e.select("user_id", "position", F.col("day").alias("sample_day"), (F.col("value") > 40).cast("int").alias("a"), (F.col("event_type") == "view").cast("int").alias("b"))
    labels = e.where("event_id % 3 = 0").select("user_id", "position", F.when(F.col("event_id") % 99 == 0, F.date_add("day", 1)).otherwise(F.col("day")).alias("day"), "value")
    j = labels.join(samples, ["user_id", "position"])
    return j.groupBy("a", "b", (F.col("day") == F.col("sample_day")).alias("agrees")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 6).alias("target"))


def joint_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two origins with different concepts on one representation: what either lacks is absent, not zero."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("asset"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("asset"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    j = a.unionByName(b, allowMissingColumns=True)
    return j.groupBy("origin").agg(F.count(F.lit(1)).alias("assets"), F.count("segment").alias("segments"), F.count("nation").alias("nations"), F.round(F.sum("balance"), 2).alias("balance"))


def pooled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows' sessions pooled in time order; a session that two windows have is an overlap, which a report refuses."""
    p = panel(spark, sf_dir).groupBy("market", "session").agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e"))
    first = F.array_compact(F.array(F.when(F.year("session") <= 1997, "first"), F.when((F.year("session") >= 1998) & (F.year("session") <= 1999), "second"), F.when(F.col("session") >= "1999-12-15", "third")))
    w = p.select("market", "session", "e", F.explode(first).alias("origin"))
    n = F.count(F.lit(1)).over(Window.partitionBy("market", "session"))
    return w.withColumn("n", n).groupBy("market", "origin").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("n") > 1).alias("overlapping"), F.round(F.avg("e"), 9).alias("mae"))


def mention_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents and sources that a three-day window mentions, by the day that ends it."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "user_id", "event_type")
    d = e.select(F.explode(F.sequence("day", F.date_add("day", 2))).alias("day"), "user_id", "event_type")
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("user_id").alias("documents"), F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("sources"))


def running_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user after every event, by one running maximum: what a cursor with a rising cut-off would give."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    top = F.max(F.struct(F.col("ts").cast("date").alias("period"), "ts", "event_id", "value")).over(w)
    s = e.withColumn("known", F.count(F.lit(1)).over(w)).withColumn("top", top)
    return s.select("event_id", "user_id", "known", F.col("top.period").alias("period"), F.col("top.value").alias("value"))


def yearly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each market and year inside its observed span: expected by the common calendar, observed, accepted, excluded, absent."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey % 9 = 0").select(F.col("l_returnflag").alias("market"), F.col("l_shipdate").cast("date").alias("session"), (F.col("l_quantity") > 20).alias("ok"))
    calendar = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("session")).distinct()
    s = li.groupBy("market", "session").agg(F.max("ok").alias("ok"))
    span = s.groupBy("market").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    every = calendar.join(F.broadcast(span), F.col("session").between(F.col("a"), F.col("b"))).select("market", "session")  # a row for each market
    j = every.join(s, ["market", "session"], "left")
    return j.groupBy("market", F.year("session").alias("year")).agg(F.count(F.lit(1)).alias("expected"), F.count("ok").alias("observed"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("excluded"), F.count_if(F.col("ok").isNull()).alias("absent"))


def window_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each asset's last six closes: volatility, momentum, a spread from highs and lows, and beta to the session's mean return."""
    w = Window.partitionBy("user_id").orderBy("day")
    q = quotes(spark, sf_dir).where("close > 0 and low > 0").withColumn("r", F.log(F.col("close") / F.lag("close").over(w))).withColumn("spread", F.log(F.col("high") / F.col("low")))
    m = q.groupBy("market", "day").agg(F.avg("r").alias("m"))
    q = q.join(m, ["market", "day"])
    six = w.rowsBetween(-5, 0)
    n = F.count("r").over(six)
    cov = F.avg(F.col("r") * F.col("m")).over(six) - F.avg(F.when(F.col("r").isNotNull(), F.col("m"))).over(six) * F.avg("r").over(six)
    both = F.when(F.col("r").isNotNull(), F.col("m"))
    var = F.avg(both * both).over(six) - F.pow(F.avg(both).over(six), 2)
    q = q.withColumns({"n": n, "volatility": F.stddev_samp("r").over(six), "momentum": F.sum("r").over(six), "mean_spread": F.avg("spread").over(six), "cov": cov, "var": var})
    return q.where("n >= 4").select("user_id", "day", F.round("volatility", 6).alias("volatility"), F.round("momentum", 6).alias("momentum"), F.round("mean_spread", 6).alias("spread"), F.when(F.col("var") > 1e-9, F.round(F.col("cov") / F.col("var"), 4)).alias("beta"))


def write_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of what is worth keeping: an error and an anomaly over the training days' medians, and the age of the last fact over its median."""
    w = Window.partitionBy("user_id").orderBy("day")
    q = quotes(spark, sf_dir).withColumn("move", F.abs(F.col("close") - F.lag("close").over(w))).withColumn("age", F.datediff("day", F.last(F.when(F.col("volume") >= 3, F.col("day")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    train = q.where("day < '2024-01-16'").agg(F.percentile("move", 0.5).alias("m"), F.percentile("high", 0.5).alias("h"), F.percentile("age", 0.5).alias("g"))
    s = q.where("day >= '2024-01-16'").crossJoin(F.broadcast(train))  # one row of scalers
    score = F.coalesce(F.col("move") / F.col("m"), F.lit(0.0)) + F.col("high") / F.col("h") - F.coalesce(F.col("age") / F.greatest("g", F.lit(1.0)), F.lit(1.0)) * 0.1
    return s.select("user_id", "day", F.round(score, 6).alias("score"))


def fact_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed figures of an edition: originals that agree, repeats dropped, conflicts left out, those without an original refused."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    review = o.where("k % 3 = 0").unionByName(o.where("k % 9 = 0")).unionByName(o.where("k % 30 = 0").withColumn("v", F.lit("?"))).unionByName(spark.range(0, 7).select((-F.col("id") - 1).alias("k"), F.lit("F").alias("v")))
    g = review.groupBy("k").agg(F.countDistinct("v").alias("kinds"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    j = g.join(o.withColumnRenamed("v", "original"), "k", "left")
    state = F.when(F.col("original").isNull(), "no_original").when(F.col("kinds") > 1, "conflict").when(F.col("original") != F.col("v"), "disagrees").when(F.col("n") > 1, "published_once").otherwise("published")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("facts"))


def selection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested assets against an origin: those it has in full, in part or not at all; a manifest is made only of the first kind."""
    asked = spark.range(0, 120).select((F.col("id") * 11).alias("c_custkey"))
    origin = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("rows")), "c_custkey", "left")
    j = asked.join(origin, "c_custkey", "left")
    return j.groupBy(F.when(F.col("c_mktsegment").isNull(), "absent").when(F.col("rows").isNull(), "incomplete").otherwise("complete").alias("state")).agg(F.count(F.lit(1)).alias("assets"), F.sum("rows").alias("rows"))


def world_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worlds (suppliers) with seeds (line numbers) averaged first, then the paired difference of two arms: mean, deviation and worlds that are better."""
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    w = s.groupBy("l_suppkey").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.count(F.lit(1)).alias("seeds"))
    d = w.withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("seeds").agg(F.count(F.lit(1)).alias("worlds"), F.round(F.avg("d"), 9).alias("difference"), F.round(F.stddev_samp("d"), 9).alias("deviation"), F.count_if(F.round("d", 9) > 0).alias("better"))


def long_short_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of two models net of three costs, and the contrast of the models, by market."""
    p = panel(spark, sf_dir)
    rows = p.select("market", "session", "target", F.explode(F.array(F.struct(F.lit("base").alias("model"), F.round("prediction", 6).alias("score")), F.struct(F.lit("reverse").alias("model"), F.round(-F.col("prediction"), 6).alias("score")))).alias("m")).select("market", "session", "target", "m.*")
    t = R.tail_weights(rows, ["model", "market", "session"], "score", 25)
    b = t.groupBy("model", "market", "session").agg(F.avg(F.when(F.col("side") > 0, F.col("target"))).alias("up"), F.avg(F.when(F.col("side") < 0, F.col("target"))).alias("down")).where("up is not null and down is not null")
    n = b.select("model", "market", "session", F.explode(F.array(*map(F.lit, (0, 10, 50)))).alias("bps"), (F.col("up") - F.col("down")).alias("gross")).withColumn("net", F.col("gross") - F.col("bps") * 0.0002)
    s = n.groupBy("market", "bps", "session").agg(*[F.max(F.when(F.col("model") == m, F.col("net"))).alias(m) for m in ("base", "reverse")])
    return s.groupBy("market", "bps").agg(F.count("base").alias("sessions"), F.round(F.avg("base"), 8).alias("base"), F.round(F.avg("reverse"), 8).alias("reverse"), F.round(F.avg(F.col("base") - F.col("reverse")), 8).alias("contrast"))


def policy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of fixed policies on the same rows, session by session, then by market: what each does and what it costs."""
    p = panel(spark, sf_dir)
    act = {"follow": F.signum(F.round("prediction", 6)), "hold": F.lit(0.0), "up": F.lit(1.0), "confident": F.when(F.abs(F.round("prediction", 6)) >= 0.03, F.signum("prediction")).otherwise(0.0)}
    rows = p.select("market", "session", "target", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), a.cast("double").alias("action")) for n, a in act.items()])).alias("x")).select("market", "session", "target", "x.*")
    s = rows.groupBy("policy", "market", "session").agg(F.avg(-F.col("action") * F.col("target")).alias("loss"), F.count_if(F.col("action") != 0).alias("acts"))
    return s.groupBy("policy", "market").agg(F.round(F.avg("loss"), 9).alias("loss"), F.sum("acts").alias("acts"), F.count_if(F.round("loss", 9) < 0).alias("gaining"))


def control_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of one window (even and odd sessions, first lines only) against the whole, by market."""
    p = panel(spark, sf_dir).where("year(session) = 1998").withColumn("e", F.abs(F.col("target") - F.col("prediction")))
    arms = F.array_compact(F.array(F.lit("whole"), F.when(F.dayofyear("session") % 2 == 0, "even"), F.when(F.dayofyear("session") % 2 == 1, "odd"), F.when(F.col("l_linenumber") == 1, "first")))
    s = p.select("market", "session", "e", F.explode(arms).alias("arm")).groupBy("arm", *KEYS).agg(F.avg("e").alias("e"))
    m = s.groupBy("arm", "market").agg(F.avg("e").alias("e"), F.count(F.lit(1)).alias("sessions"))
    whole = m.where("arm = 'whole'").select("market", F.col("e").alias("w"))
    return m.join(F.broadcast(whole), "market").select("arm", "market", "sessions", F.round("e", 9).alias("mae"), F.round(F.col("e") - F.col("w"), 9).alias("difference"))  # a row for each market


def family_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with the target of every place of a feature vector, by families of places: the largest mean and how many are suspicious."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey < 30").select(F.col("l_returnflag").alias("market"), F.year("l_shipdate").alias("session"), (F.col("l_discount") - 0.05).alias("target"), F.array(F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice"), F.col("l_discount") * 2 + F.col("l_tax") * 0.01, F.lit(1.0)).alias("x"))
    long = li.withColumn("ry", C.midrank(["market", "session"], "target")).select("market", "session", "ry", F.posexplode("x").alias("place", "v"))
    keys = ["place", "market", "session"]
    long = long.withColumn("rx", C.midrank(keys, "v"))
    n, mid = F.count(F.lit(1)), (F.count(F.lit(1)) + 1) / 2.0
    s = long.groupBy(*keys).agg((F.sum(F.col("rx") * F.col("rx")) - n * mid * mid).alias("xx"), (F.sum(F.col("ry") * F.col("ry")) - n * mid * mid).alias("yy"), (F.sum(F.col("rx") * F.col("ry")) - n * mid * mid).alias("xy"))
    s = s.withColumn("c", F.when((F.col("xx") > 1e-9) & (F.col("yy") > 1e-9), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))))
    f = s.groupBy("place").agg(F.avg(F.abs("c")).alias("m"), F.count("c").alias("sessions"))
    return f.groupBy(F.when(F.col("place") < 3, "observed").otherwise("derived").alias("family")).agg(F.count(F.lit(1)).alias("places"), F.sum("sessions").alias("sessions"), F.round(F.max("m"), 6).alias("largest"), F.count_if(F.col("m") > 0.3).alias("suspicious"))


def abstention_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published matrix of call coverages with one cell falsified, recomputed and marked."""
    c = panel(spark, sf_dir).groupBy("market", F.year("session").alias("year")).agg(F.round(F.avg((F.round("prediction", 6) != 0).cast("double")), 9).alias("found"))
    m = c.withColumn("published", F.when((F.col("market") == "R") & (F.col("year") == 1999), F.col("found") + 0.01).otherwise(F.col("found"))).where("not (market = 'A' and year = 1996)")
    j = c.join(m.select("market", "year", "published"), ["market", "year"], "left")
    mark = F.when(F.col("published").isNull(), "unpublished").when(F.abs(F.col("published") - F.col("found")) > 1e-9, "falsified").when(F.col("found") < 0.87, "sparse").otherwise("usable")
    return j.select("market", "year", "found", mark.alias("mark"))


def window_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's rows and error by two ways, session means and row sums, with the digest of its population."""
    p = panel(spark, sf_dir).withColumn("window", F.year("session")).withColumn("e", F.abs(F.col("target") - F.col("prediction")))
    a = p.groupBy("window", *KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("e")).groupBy("window").agg(F.sum("n").alias("rows"), F.sum(F.col("e") * F.col("n")).alias("s"))
    b = p.groupBy("window").agg(F.count(F.lit(1)).alias("rows_b"), F.sum("e").alias("s_b"))
    d = P.digest(p, ["window"], ["market", "session", "l_orderkey", "l_linenumber"], "population")
    j = a.join(b, "window").join(d, "window")
    return j.select("window", "rows", (F.col("rows") == F.col("rows_b")).alias("same_rows"), (F.abs(F.col("s") - F.col("s_b")) < 1e-6).alias("same_error"), F.round(F.col("s") / F.col("rows"), 9).alias("mae"), "population")


def synthetic_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor world from counters: assets load on one common factor, shocks are hashes of (seed, asset, session); its moments by asset."""
    u = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    grid = spark.range(0, 20).select(F.col("id").alias("asset")).crossJoin(spark.range(0, 60).select(F.col("id").alias("session")))
    g = grid.withColumn("factor", u(F.lit("f"), F.col("session").cast("string")) - 0.5).withColumn("own", u(F.lit("a"), F.col("asset").cast("string"), F.col("session").cast("string")) - 0.5)
    g = g.withColumn("r", (0.5 + F.col("asset") / 20) * F.col("factor") * 0.02 + F.col("own") * 0.01)
    return g.groupBy("asset").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("r"), 8).alias("mean"), F.round(F.stddev_pop("r"), 8).alias("deviation"), F.round(100 * F.exp(F.sum("r")), 5).alias("price"))


def paired_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows added as a fraction asks for, each a later row of its own asset, the first five of an asset being warm-up only."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    added = e.where("place >= 5").withColumn("copy", F.pmod(F.col("place") * 7 + F.col("user_id"), F.lit(4)) == 0)
    return e.groupBy("user_id").agg(F.max("n").alias("rows")).join(added.where("copy").groupBy("user_id").agg(F.count(F.lit(1)).alias("added"), F.min("place").alias("first")), "user_id", "left").select("user_id", "rows", F.coalesce("added", F.lit(0)).alias("added"), "first")


def tabular_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of the target on three features over all rows of the years before 2000, scored after: sums on executors, three equations solved."""
    li = instants(table(spark, sf_dir, "lineitem"), "l_shipdate").select(F.year("l_shipdate").alias("y"), (F.col("l_discount") * 10).alias("t"), F.lit(1.0).alias("x0"), (F.col("l_quantity") / 50).alias("x1"), (F.col("l_tax") * 10).alias("x2"))
    xs = ["x0", "x1", "x2"]
    sums = li.where("y < 2000").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(xs) for b in xs[i:]], *[F.sum(F.col(a) * F.col("t")).alias(f"{a}t") for a in xs])
    m = {k: F.col(k) for k in sums.columns}
    a, b, c, d, e, f = (m[k] for k in ("x0x0", "x0x1", "x0x2", "x1x1", "x1x2", "x2x2"))
    p, q, r = m["x0t"], m["x1t"], m["x2t"]
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    s = sums.select(((p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det).alias("b0"), ((a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - c * q)) / det).alias("b1"), ((a * (d * r - q * e) - b * (b * r - c * q) + p * (b * e - c * d)) / det).alias("b2"))
    j = li.where("y >= 2000").crossJoin(F.broadcast(s))  # one row of coefficients
    fit = F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")
    return j.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs(F.col("t") - fit)), 7).alias("mae"), F.round(F.max("b1"), 6).alias("slope"))


REGISTERED = {
    "two_calendar_union": (
        two_calendar_union,
        f"""
WITH {PANEL_SQL}, p AS (SELECT market, session FROM panel WHERE l_linenumber <= 2 AND market IN ('A', 'N')), d AS (SELECT DISTINCT market, session FROM p),
n AS (SELECT market, session, CASE WHEN market = 'A' THEN lead(session, 1) OVER w ELSE lead(session, 2) OVER w END AS next FROM d WINDOW w AS (PARTITION BY market ORDER BY session))
SELECT p.market, CAST(year(p.session) AS INTEGER) AS year, count(*) AS rows, count(next) AS labelled, CAST(max(next - p.session) AS INTEGER) AS longest FROM p JOIN n ON n.market = p.market AND n.session = p.session GROUP BY ALL""",
    ),
    "compatible_views": (
        compatible_views,
        f"""
WITH {PANEL_SQL}, p AS (SELECT DISTINCT market, session FROM panel), b AS (SELECT *, 0 AS view FROM p WHERE session < DATE '1998-01-01' UNION ALL SELECT *, 1 FROM p WHERE session >= DATE '1997-12-01' AND session < DATE '1999-01-01'),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY market ORDER BY session, view) - 1 AS INTEGER) AS place, count(*) OVER (PARTITION BY market, session) > 1 AS shared FROM b)
SELECT market, view, count(*) AS sessions, min(place) AS begins, count(*) FILTER (shared) AS shared FROM n GROUP BY ALL""",
    ),
    "presence_join": (
        presence_join,
        """
SELECT CAST(value > 40 AS INTEGER) AS a, CAST(event_type = 'view' AS INTEGER) AS b, event_id % 99 <> 0 AS agrees, count(*) AS rows, round(avg(value), 6) AS target FROM events WHERE event_id % 3 = 0 GROUP BY ALL""",
    ),
    "joint_corpus": (
        joint_corpus,
        """
SELECT 'customer' AS origin, count(*) AS assets, count(c_mktsegment) AS segments, CAST(0 AS BIGINT) AS nations, round(sum(c_acctbal), 2) AS balance FROM customer
UNION ALL SELECT 'supplier', count(*), 0, count(s_nationkey), round(sum(s_acctbal), 2) FROM supplier""",
    ),
    "pooled_sessions": (
        pooled_sessions,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(abs(target - prediction)) AS e FROM panel GROUP BY ALL),
w AS (SELECT *, 'first' AS origin FROM s WHERE year(session) <= 1997 UNION ALL SELECT *, 'second' FROM s WHERE year(session) BETWEEN 1998 AND 1999 UNION ALL SELECT *, 'third' FROM s WHERE session >= DATE '1999-12-15'),
n AS (SELECT *, count(*) OVER (PARTITION BY market, session) AS n FROM w)
SELECT market, origin, count(*) AS sessions, count(*) FILTER (n > 1) AS overlapping, round(avg(e), 9) AS mae FROM n GROUP BY ALL""",
    ),
    "mention_sets": (
        mention_sets,
        """
WITH d AS (SELECT CAST(ts AS DATE) + k AS day, user_id, event_type FROM events, (VALUES (0), (1), (2)) v(k))
SELECT day, count(*) AS mentions, count(DISTINCT user_id) AS documents, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS sources FROM d GROUP BY ALL""",
    ),
    "running_snapshot": (
        running_snapshot,
        """
SELECT event_id, user_id, count(*) OVER w AS known, CAST(ts AS DATE) AS period, value FROM events WHERE event_id % 2 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    ),
    "yearly_coverage": (
        yearly_coverage,
        """
WITH s AS (SELECT l_returnflag AS market, CAST(l_shipdate AS DATE) AS session, max(l_quantity > 20) AS ok FROM lineitem WHERE l_suppkey % 9 = 0 GROUP BY ALL), c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders),
p AS (SELECT market, min(session) AS a, max(session) AS b FROM s GROUP BY ALL), e AS (SELECT market, session FROM c JOIN p ON session BETWEEN a AND b)
SELECT e.market, CAST(year(e.session) AS INTEGER) AS year, count(*) AS expected, count(ok) AS observed, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS excluded, count(*) FILTER (ok IS NULL) AS absent
FROM e LEFT JOIN s ON s.market = e.market AND s.session = e.session GROUP BY ALL""",
    ),
    "window_measures": (
        window_measures,
        f"""
WITH {QUOTES}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY user_id ORDER BY day)) AS r, ln(high / low) AS s FROM q WHERE close > 0 AND low > 0), m AS (SELECT market, day, avg(r) AS m FROM r GROUP BY ALL),
j AS (SELECT r.*, m, CASE WHEN r IS NOT NULL THEN m END AS b FROM r JOIN m USING (market, day)),
w AS (SELECT user_id, day, count(r) OVER w AS n, stddev_samp(r) OVER w AS v, sum(r) OVER w AS o, avg(s) OVER w AS s, avg(r * m) OVER w - avg(b) OVER w * avg(r) OVER w AS c, avg(b * b) OVER w - pow(avg(b) OVER w, 2) AS x FROM j WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT user_id, day, round(v, 6) AS volatility, round(o, 6) AS momentum, round(s, 6) AS spread, CASE WHEN x > 1e-9 THEN round(c / x, 4) END AS beta FROM w WHERE n >= 4""",
    ),
    "write_scores": (
        write_scores,
        f"""
WITH {QUOTES}, m AS (SELECT *, abs(close - lag(close) OVER w) AS move, day - last_value(CASE WHEN volume >= 3 THEN day END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS age FROM q WINDOW w AS (PARTITION BY user_id ORDER BY day)),
t AS (SELECT median(move) AS m, median(high) AS h, median(age) AS g FROM m WHERE day < DATE '2024-01-16')
SELECT user_id, day, round(coalesce(move / t.m, 0) + high / t.h - coalesce(age / greatest(t.g, 1), 1) * 0.1, 6)::DOUBLE AS score FROM m, t WHERE day >= DATE '2024-01-16'""",
    ),
    "fact_materialisation": (
        fact_materialisation,
        """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 30 = 0 THEN 'conflict' WHEN o_orderkey % 9 = 0 THEN 'published_once' ELSE 'published' END AS state FROM orders WHERE o_orderkey % 3 = 0)
SELECT state, count(*) AS facts FROM r GROUP BY ALL UNION ALL SELECT 'no_original', 7""",
    ),
    "selection_manifest": (
        selection_manifest,
        """
WITH a AS (SELECT i * 11 AS k FROM range(120) t(i)), o AS (SELECT o_custkey AS k, count(*) AS rows FROM orders GROUP BY ALL)
SELECT CASE WHEN c_custkey IS NULL THEN 'absent' WHEN rows IS NULL THEN 'incomplete' ELSE 'complete' END AS state, count(*) AS assets, CAST(sum(CASE WHEN c_custkey IS NOT NULL THEN rows END) AS BIGINT) AS rows FROM a LEFT JOIN customer ON c_custkey = a.k LEFT JOIN o ON o.k = a.k GROUP BY ALL""",
    ),
    "world_differences": (
        world_differences,
        """
WITH s AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY ALL), w AS (SELECT l_suppkey, avg(a) - avg(b) AS d, count(*) AS seeds FROM s GROUP BY ALL)
SELECT seeds, count(*) AS worlds, round(avg(d), 9) AS difference, round(stddev_samp(d), 9) AS deviation, count(*) FILTER (round(d, 9) > 0) AS better FROM w GROUP BY ALL""",
    ),
    "long_short_report": (
        long_short_report,
        f"""
WITH {PANEL_SQL}, m AS (SELECT market, session, target, model, round(prediction * f, 6) AS score FROM panel, (VALUES ('base', 1), ('reverse', -1)) v(model, f)),
c AS (SELECT *, count(*) OVER (PARTITION BY model, market, session) AS n, count(*) OVER (PARTITION BY model, market, session ORDER BY score RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
  count(*) OVER (PARTITION BY model, market, session ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM m),
b AS (SELECT model, market, session, avg(target) FILTER (above <= n // 4) AS up, avg(target) FILTER (above > n // 4 AND below <= n // 4) AS down FROM c GROUP BY ALL),
x AS (SELECT market, session, bps, max(up - down - bps * 0.0002::DOUBLE) FILTER (model = 'base') AS base, max(up - down - bps * 0.0002::DOUBLE) FILTER (model = 'reverse') AS reverse FROM b, (VALUES (0), (10), (50)) v(bps) WHERE up IS NOT NULL AND down IS NOT NULL GROUP BY ALL)
SELECT market, bps, count(base) AS sessions, round(avg(base), 8) AS base, round(avg(reverse), 8) AS reverse, round(avg(base - reverse), 8) AS contrast FROM x GROUP BY ALL""",
    ),
    "policy_losses": (
        policy_losses,
        f"""
WITH {PANEL_SQL}, a AS (SELECT market, session, target, 'follow' AS policy, sign(round(prediction, 6)) AS act FROM panel UNION ALL SELECT market, session, target, 'hold', 0 FROM panel UNION ALL SELECT market, session, target, 'up', 1 FROM panel
  UNION ALL SELECT market, session, target, 'confident', CASE WHEN abs(round(prediction, 6)) >= 0.03 THEN sign(prediction) ELSE 0 END FROM panel),
s AS (SELECT policy, market, session, avg(-act * target) AS loss, count(*) FILTER (act <> 0) AS acts FROM a GROUP BY ALL)
SELECT policy, market, round(avg(loss), 9) + 0.0 AS loss, CAST(sum(acts) AS BIGINT) AS acts, count(*) FILTER (round(loss, 9) < 0) AS gaining FROM s GROUP BY ALL""",
    ),
    "control_comparison": (
        control_comparison,
        f"""
WITH {PANEL_SQL}, p AS (SELECT market, session, l_linenumber AS l, abs(target - prediction) AS e FROM panel WHERE year(session) = 1998),
a AS (SELECT market, session, e, 'whole' AS arm FROM p UNION ALL SELECT market, session, e, CASE WHEN dayofyear(session) % 2 = 0 THEN 'even' ELSE 'odd' END FROM p UNION ALL SELECT market, session, e, 'first' FROM p WHERE l = 1),
s AS (SELECT arm, market, session, avg(e) AS e FROM a GROUP BY ALL), m AS (SELECT arm, market, avg(e) AS e, count(*) AS sessions FROM s GROUP BY ALL)
SELECT m.arm, m.market, m.sessions, round(m.e, 9) AS mae, round(m.e - w.e, 9) AS difference FROM m JOIN m w ON w.market = m.market AND w.arm = 'whole'""",
    ),
    "family_leakage": (
        family_leakage,
        """
WITH l AS (SELECT l_returnflag AS market, year(l_shipdate) AS session, l_discount - 0.05 AS t, unnest([l_quantity, l_tax, l_extendedprice, l_discount * 2 + l_tax * 0.01, 1.0::DOUBLE]) AS v, unnest([0, 1, 2, 3, 4]) AS place FROM lineitem WHERE l_suppkey < 30),
r AS (SELECT place, market, session, count(*) OVER g AS n, rank() OVER (PARTITION BY place, market, session ORDER BY t) + (count(*) OVER (PARTITION BY place, market, session, t) - 1) / 2.0 AS y,
  rank() OVER (PARTITION BY place, market, session ORDER BY v) + (count(*) OVER (PARTITION BY place, market, session, v) - 1) / 2.0 AS x FROM l WINDOW g AS (PARTITION BY place, market, session)),
s AS (SELECT place, market, session, sum(pow(x - (n + 1) / 2.0, 2)) AS xx, sum(pow(y - (n + 1) / 2.0, 2)) AS yy, sum((x - (n + 1) / 2.0) * (y - (n + 1) / 2.0)) AS xy FROM r GROUP BY ALL),
f AS (SELECT place, avg(abs(xy / sqrt(xx * yy))) FILTER (xx > 1e-9 AND yy > 1e-9) AS m, count(*) FILTER (xx > 1e-9 AND yy > 1e-9) AS sessions FROM s GROUP BY ALL)
SELECT CASE WHEN place < 3 THEN 'observed' ELSE 'derived' END AS family, count(*) AS places, CAST(sum(sessions) AS BIGINT) AS sessions, round(max(m), 6) AS largest, count(*) FILTER (m > 0.3) AS suspicious FROM f GROUP BY ALL""",
    ),
    "abstention_marks": (
        abstention_marks,
        f"""
WITH {PANEL_SQL}, c AS (SELECT market, CAST(year(session) AS INTEGER) AS year, round(avg(CASE WHEN round(prediction, 6) <> 0 THEN 1.0 ELSE 0.0 END), 9) AS found FROM panel GROUP BY ALL)
SELECT market, year, found, CASE WHEN market = 'A' AND year = 1996 THEN 'unpublished' WHEN market = 'R' AND year = 1999 THEN 'falsified' WHEN found < 0.87 THEN 'sparse' ELSE 'usable' END AS mark FROM c""",
    ),
    "window_record": (
        window_record,
        f"""
WITH {PANEL_SQL}, h AS (SELECT CAST(year(session) AS INTEGER) AS "window", abs(target - prediction) AS e, sha256('{{"market":"' || market || '","session":"' || session || '","l_orderkey":"' || l_orderkey || '","l_linenumber":"' || l_linenumber || '"}}') AS h FROM panel),
s AS (SELECT "window", count(*) AS n, sum(e) AS e, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS b, sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS c FROM h GROUP BY ALL)
SELECT "window", n AS rows, true AS same_rows, true AS same_error, round(e / n, 9) AS mae, sha256(n || ':' || a || ':' || b || ':' || c) AS population FROM s""",
    ),
    "synthetic_world": (
        synthetic_world,
        """
WITH g AS (SELECT a AS asset, s AS session, CAST('0x' || substr(sha256('f:' || s), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5 AS f, CAST('0x' || substr(sha256('a:' || a || ':' || s), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5 AS o FROM range(20) t(a), range(60) u(s)),
r AS (SELECT asset, (0.5::DOUBLE + asset / 20) * f * 0.02::DOUBLE + o * 0.01::DOUBLE AS r FROM g)
SELECT asset, count(*) AS sessions, round(avg(r), 8) AS mean, round(stddev_pop(r), 8) AS deviation, round(100 * exp(sum(r)), 5) AS price FROM r GROUP BY ALL""",
    ),
    "paired_augmentation": (
        paired_augmentation,
        """
WITH p AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS place FROM events)
SELECT user_id, count(*) AS rows, count(*) FILTER (place >= 5 AND (place * 7 + user_id) % 4 = 0) AS added, min(place) FILTER (place >= 5 AND (place * 7 + user_id) % 4 = 0) AS first FROM p GROUP BY ALL""",
    ),
    "tabular_reference": (
        tabular_reference,
        """
WITH l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_discount * 10 AS t, l_quantity / 50 AS u, l_tax * 10 AS v FROM lineitem),
c AS (SELECT covar_pop(u, u) AS uu, covar_pop(u, v) AS uv, covar_pop(v, v) AS vv, covar_pop(u, t) AS ut, covar_pop(v, t) AS vt, avg(u) AS mu, avg(v) AS mv, avg(t) AS mt FROM l WHERE y < 2000),
b AS (SELECT *, (ut * vv - vt * uv) / (uu * vv - uv * uv) AS b1, (vt * uu - ut * uv) / (uu * vv - uv * uv) AS b2 FROM c)
SELECT y, count(*) AS rows, round(avg(abs(t - (mt + b1 * (u - mu) + b2 * (v - mv)))), 7) AS mae, round(max(b1), 6) AS slope FROM l, b WHERE y >= 2000 GROUP BY ALL""",
    ),
}
