"""Queries over decision inputs and comparisons of variants: admission, contexts, windows, gates, seeds and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.functions import noise
from tidemark.operators import contexts as X
from tidemark.operators import relational as R
from tidemark.plans.panel import KEYS, PANEL_SQL, panel
from tidemark.plans.timeline import DAILY, daily
from tidemark.session import instants, table

TYPES = ["click", "error", "purchase", "signup", "view"]


def admission_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines ship after a horizon: the modalities not available by the cutoff, counted by combination."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cutoff = F.col("o_orderdate") + F.expr("interval 60 days")
    return j.groupBy(F.array_join(X.violations(cutoff, {"first": F.col("first"), "last": F.col("last")}), "+").alias("violations")).agg(F.count(F.lit(1)).alias("orders"))


def observation_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values at a cutoff: usable ones with their age, others by reason."""
    e = instants(table(spark, sf_dir, "events"), "ts")
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    u = X.usability(F.when(F.col("value") > 0.5, F.col("value")), at, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return e.select(u.alias("u")).groupBy(F.coalesce("u.reason", F.lit("usable")).alias("state")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("u.value"), 5).alias("total"), F.round(F.avg("u.age_days"), 7).alias("mean_age"))


def macro_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the types' mean values as one vector in declared order, its signed logs and masks."""
    d = table(spark, sf_dir, "events").where("not (event_type = 'view' and event_id % 2 = 0)").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.avg("value").alias("v"))
    v = X.long_to_vector(d, ["day"], "event_type", "v", [*TYPES, "absent"])
    c = v.select("day", X.numeric_context(F.col("vector"), F.transform("vector", lambda x: F.when(x.isNotNull(), F.lit(1.0)))).alias("c"))
    return c.select("day", F.size("c").alias("width"), *[F.round(F.get("c", i), 7).alias(f"c{i}") for i in (0, 4, 5, 6, 11, 12, 17)])


def information_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily vector without a variable and all that depend on it."""
    uses = {"purchase": {"click"}, "signup": {"purchase"}}
    drop = sorted(TYPES.index(x) for x in X.closed_under(uses, {"click"}))
    d = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("v"))
    v = X.long_to_vector(d, ["day"], "event_type", "v", TYPES).select("day", X.without(F.col("vector"), drop).alias("v"))
    return v.select("day", F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("kept"), F.size(F.filter("v", lambda x: x == 0)).alias("zeros"))


def context_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's counts by type projected to another vocabulary's order."""
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("v"))
    m = d.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "v")).alias("s"))
    p = X.projected(F.transform("s", lambda x: x["event_type"]), F.transform("s", lambda x: x["v"]), ["view", "unknown", "click"])
    return m.select("user_id", *[F.get(p, i).alias(n) for i, n in enumerate(("view", "unknown", "click"))])


def price_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-day windows of a user's days on the calendar axis: present slots, and features of the last slot."""
    d = daily(spark, sf_dir).where("value > 0").withColumn("place", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long"))
    w = X.price_window(d, ["user_id"], "day", "place", ["value", "volume"], 10, "window")
    last = F.element_at(X.window_features(F.col("window"), "value", "volume"), -1)
    return w.select("user_id", "day", "present", F.round(last["level"], 7).alias("level"), F.round(last["turnover"], 7).alias("turnover"))


def candle_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of each user's values: body and wicks over the high of the last ten candles; NaN or infinite where that is zero."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", F.struct("ts", "event_id")).alias("c"))
    scale = F.max("h").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(-9, 0))
    e = e.withColumn("scale", scale)
    over = lambda c: F.round(C.float_ratio(c, F.col("scale")), 7)
    return e.select("user_id", "day", over(F.col("c") - F.col("o")).alias("body"), over(F.col("h") - F.greatest("o", "c")).alias("upper"), over(F.least("o", "c") - F.col("l")).alias("lower"))


def shrinkage_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions times a factor of their region, else of their market, else zero; and abstention where an interval holds zero."""
    markets = spark.createDataFrame([("A", 0.5), ("N", 0.8)], "market string, mf double")
    regions = spark.createDataFrame([("A", 1, 0.25), ("R", 2, 0.75)], "market string, region int, rf double")
    rows = panel(spark, sf_dir).withColumn("region", (F.col("l_linenumber") % 3).cast("int")).join(F.broadcast(markets), "market", "left").join(F.broadcast(regions), ["market", "region"], "left")
    g = X.gated(F.col("prediction"), F.col("rf"), F.col("mf"))
    n = X.neutral(F.round("prediction", 6), F.round(F.col("prediction") - 0.015, 6), F.round(F.col("prediction") + 0.015, 6))
    return rows.groupBy("market").agg(F.round(F.avg(F.abs(F.col("target") - g)), 9).alias("gated_mae"), F.count_if(n == 0).alias("abstained"), F.round(F.sum(F.abs(n)), 5).alias("called"))


def seed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeds of a model averaged per session, against a control; only sessions with every seed."""
    rows = panel(spark, sf_dir).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    e = rows.groupBy(*KEYS, "seed").agg(F.avg(F.abs(F.col("target") - F.col("prediction") * (1 + F.col("seed") * 0.1))).alias("e"), F.avg(F.abs("target")).alias("control"))
    s = e.groupBy(*KEYS).agg(F.avg("e").alias("e"), F.avg("control").alias("c"), F.count(F.lit(1)).alias("seeds")).where("seeds = 3")
    return s.groupBy("market").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg(F.col("c") - F.col("e")), 9).alias("delta"), F.count_if(F.round(F.col("c") - F.col("e"), 9) > 0).alias("better"))


def minimum_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and lag-1 autocorrelation of the session errors, and the effective number of sessions."""
    s = panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e"))
    w = Window.partitionBy("market")
    s = s.withColumn("c", F.col("e") - F.avg("e").over(w)).withColumn("l", F.lag("c").over(w.orderBy("session")))
    a = s.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("e").alias("sd"), (F.sum(F.col("c") * F.col("l")) / F.sum(F.col("c") * F.col("c"))).alias("r"))
    return a.select("market", "n", F.round("sd", 9).alias("deviation"), F.round("r", 7).alias("autocorrelation"), F.round(F.col("n") * (1 - F.greatest("r", F.lit(0.0))) / (1 + F.greatest("r", F.lit(0.0))), 4).alias("effective"))


def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving blocks without wrapping: means of ten replicates of the market's session errors, starts from a fixed rule."""
    s = panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e"))
    s = s.withColumn("p", F.row_number().over(Window.partitionBy("market").orderBy("session")) - 1)
    n = s.groupBy("market").agg(F.count(F.lit(1)).alias("n"))
    d = n.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 10.0).cast("int") - 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    d = d.where(F.col("block") * 10 + F.col("k") < F.col("n")).withColumn("p", F.pmod(F.col("replicate") * 7919 + F.col("block") * 104729, F.col("n") - 9) + F.col("k"))
    c = d.groupBy("market", "replicate", "p").agg(F.count(F.lit(1)).alias("t"))
    return c.join(s, ["market", "p"]).groupBy("market", "replicate").agg(F.round(F.sum(F.col("t") * F.col("e")) / F.sum("t"), 9).alias("mean"))


def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within-session shuffles of the target by hash order: mean absolute difference to the prediction for three permutations."""
    p = panel(spark, sf_dir)
    w = Window.partitionBy(*KEYS)
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), "l_orderkey", "l_linenumber", "session").cast("binary"), 256)
    base = p.withColumn("i", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "target", "prediction")))
    out = None
    for k in range(3):
        t = p.withColumn("i", F.row_number().over(w.orderBy(h(f"perm{k}"), "target"))).select(*KEYS, "i", F.col("target").alias("other"))
        part = base.join(t, [*KEYS, "i"]).groupBy("market").agg(F.lit(k).alias("permutation"), F.round(F.avg(F.abs(F.col("other") - F.col("prediction"))), 5).alias("mae"))
        out = part if out is None else out.unionByName(part)
    return out


def coverage_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered rows by year and market, and the mean deviation from the nominal coverage over non-empty cells."""
    inside = F.round(F.abs(F.col("target") - F.col("prediction")), 9) <= 0.05
    c = panel(spark, sf_dir).groupBy(F.year("session").alias("year"), "market").agg(F.count(F.lit(1)).alias("rows"), F.count_if(inside).alias("covered"))
    return c.groupBy("market").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg(F.abs(F.col("covered") / F.col("rows") - 0.9)), 9).alias("deviation"))


def action_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market the best of 21 equally spaced constant actions by mean absolute loss."""
    p = panel(spark, sf_dir).groupBy("market", F.round("target", 6).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    g = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("action", F.round((F.col("k") - 10) * 0.005, 6))
    loss = g.groupBy("market", "action").agg((F.sum(F.col("n") * F.abs(F.col("t") - F.col("action"))) / F.sum("n")).alias("loss"))
    w = Window.partitionBy("market").orderBy(F.round("loss", 9), "action")
    return loss.withColumn("r", F.row_number().over(w)).where("r = 1").select("market", "action", F.round("loss", 9).alias("loss"))


def asset_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the modalities they have (orders, lines) and those missing; incomplete ones are kept."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    have = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count("l_orderkey").alias("with_lines"))
    j = c.join(have, F.col("c_custkey") == F.col("o_custkey"), "left")
    missing = C.exclusion_reasons(("orders", F.col("orders").isNull()), ("lines", F.coalesce("with_lines", F.lit(0)) == 0))
    return j.groupBy(F.array_join(missing, "+").alias("missing")).agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"))


def sector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by region through nation, unknown ones kept as a group."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.coalesce("r_name", F.lit("unknown")).alias("region")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def publication_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability of a source day: its end in the source's zone, as a day in two markets' zones, and the month it counts for."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    end = F.to_utc_timestamp((F.date_add("day", 1)).cast("timestamp"), "America/New_York")
    return e.select("day", end.cast("timestamp_ntz").alias("available_at"), C.next_instant_day(end, "Asia/Shanghai").alias("shanghai_day"), C.next_instant_day(end, "America/New_York").alias("york_day"), F.trunc("day", "MM").alias("month"), F.add_months("day", 1).alias("month_on"))


def burst_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts by user and block of five days: a block's rows are perturbed if its draw is under the share; days since the last burst."""
    d = daily(spark, sf_dir).withColumn("block", F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 5))
    d = d.withColumn("u", noise.uniform((F.col("user_id") * 1000 + F.col("block")).cast("long"))).withColumn("burst", F.col("u") < 0.3)
    last = F.last(F.when(F.col("burst"), F.col("day")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("user_id", "day", F.round("u", 9).alias("draw"), "burst", F.datediff("day", last).alias("since"))


REGISTERED = {
    "burst_perturbation": (
        burst_perturbation,
        f"""
WITH {DAILY}, k AS (SELECT user_id, day, user_id * 1000 + (day - DATE '2024-01-01') // 5 AS c FROM d),
a AS (SELECT *, (CAST(c AS UHUGEINT) + 1) * 11400714819323198485::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM k),
b AS (SELECT *, xor(z, z >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS y FROM a),
c2 AS (SELECT *, xor(y, y >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS x FROM b),
u AS (SELECT user_id, day, CAST(xor(x, x >> 31::UHUGEINT) >> 11::UHUGEINT AS DOUBLE) / 9007199254740992 AS u FROM c2)
SELECT user_id, day, round(u, 9) AS draw, u < 0.3 AS burst, day - max(CASE WHEN u < 0.3 THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS since FROM u""",
    ),
    "admission_barrier": (
        admission_barrier,
        """
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY ALL),
v AS (SELECT concat_ws('+', CASE WHEN a IS NULL OR a > o_orderdate + INTERVAL 60 DAY THEN 'first' END, CASE WHEN b IS NULL OR b > o_orderdate + INTERVAL 60 DAY THEN 'last' END) AS violations FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT violations, count(*) AS orders FROM v GROUP BY ALL""",
    ),
    "observation_usability": (
        observation_usability,
        """
WITH e AS (SELECT CASE WHEN value > 0.5 THEN value END AS v, CASE WHEN event_id % 11 <> 0 THEN ts END AS t FROM events),
s AS (SELECT *, CASE WHEN v IS NULL THEN 'missing_value' WHEN t IS NULL THEN 'unknown_publication' WHEN t > TIMESTAMP '2024-01-20' THEN 'not_yet_available' ELSE 'usable' END AS state FROM e)
SELECT state, count(*) AS events, round(sum(CASE WHEN state = 'usable' THEN v END), 5) AS total, round(avg(CASE WHEN state = 'usable' THEN (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t)) / 86400e6 END), 7) AS mean_age FROM s GROUP BY ALL""",
    ),
    "macro_vector": (
        macro_vector,
        """
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS e FROM events WHERE NOT (event_type = 'view' AND event_id % 2 = 0) GROUP BY ALL)
SELECT day, 18 AS width, coalesce(round(ln(1 + a), 7), 0) AS c0, coalesce(round(ln(1 + e), 7), 0) AS c4, 0.0::DOUBLE AS c5, CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE 1 END AS c6, 0.0::DOUBLE AS c11, CASE WHEN a IS NULL THEN 0 ELSE round(ln(2.0), 7) END AS c12, 0.0::DOUBLE AS c17 FROM d""",
    ),
    "information_view": (
        information_view,
        "SELECT CAST(ts AS DATE) AS day, CAST(count(*) FILTER (event_type IN ('error', 'view')) AS DOUBLE) AS kept, 3 AS zeros FROM events GROUP BY 1",
    ),
    "context_projection": (
        context_projection,
        "SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS view, 0.0::DOUBLE AS unknown, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS click FROM events GROUP BY 1",
    ),
    "price_windows": (
        price_windows,
        f"""
WITH {DAILY}, v AS (SELECT * FROM d WHERE value > 0),
w AS (SELECT user_id, day, value, volume, count(*) OVER w AS present, first_value(value) OVER w AS anchor, avg(volume) OVER w AS mean FROM v WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW))
SELECT user_id, day, CAST(present AS INTEGER) AS present, round(ln(value / anchor), 7) + 0.0 AS level, round(ln(1 + volume / mean), 7) AS turnover FROM w""",
    ),
    "candle_geometry": (
        candle_geometry,
        """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c FROM events GROUP BY 1, 2),
s AS (SELECT *, max(h) OVER (PARTITION BY user_id ORDER BY day ROWS 9 PRECEDING) AS scale FROM e)
SELECT user_id, day, round((c - o) / scale, 7) AS body, round((h - greatest(o, c)) / scale, 7) AS upper, round((least(o, c) - l) / scale, 7) AS lower FROM s""",
    ),
    "shrinkage_and_gates": (
        shrinkage_and_gates,
        f"""
WITH {PANEL_SQL}, m(market, mf) AS (VALUES ('A', 0.5::DOUBLE), ('N', 0.8)), r(market, region, rf) AS (VALUES ('A', 1, 0.25::DOUBLE), ('R', 2, 0.75)),
j AS (SELECT p.*, coalesce(rf, mf, 0) * prediction AS g, CASE WHEN round(prediction - 0.015, 6) > 0 OR round(prediction + 0.015, 6) < 0 THEN round(prediction, 6) ELSE 0 END AS n FROM panel p LEFT JOIN m ON p.market = m.market LEFT JOIN r ON p.market = r.market AND r.region = l_linenumber % 3)
SELECT market, round(avg(abs(target - g)), 9) AS gated_mae, count(*) FILTER (n = 0) AS abstained, round(sum(abs(n)), 5) AS called FROM j GROUP BY ALL""",
    ),
    "seed_deltas": (
        seed_deltas,
        f"""
WITH {PANEL_SQL}, e AS (SELECT market, session, seed, avg(abs(target - prediction * (1 + seed * 0.1::DOUBLE))) AS e, avg(abs(target)) AS c FROM panel, range(3) t(seed) GROUP BY ALL),
s AS (SELECT market, session, avg(e) AS e, avg(c) AS c FROM e GROUP BY ALL HAVING count(*) = 3)
SELECT market, count(*) AS sessions, round(avg(c - e), 9) AS delta, count(*) FILTER (round(c - e, 9) > 0) AS better FROM s GROUP BY ALL""",
    ),
    "minimum_effect": (
        minimum_effect,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(abs(target - prediction)) AS e FROM panel GROUP BY ALL),
c AS (SELECT *, e - avg(e) OVER (PARTITION BY market) AS c FROM s),
l AS (SELECT *, lag(c) OVER (PARTITION BY market ORDER BY session) AS l FROM c),
a AS (SELECT market, count(*) AS n, stddev_samp(e) AS sd, sum(c * l) / sum(c * c) AS r FROM l GROUP BY ALL)
SELECT market, n, round(sd, 9) AS deviation, round(r, 7) AS autocorrelation, round(n * (1 - greatest(r, 0)) / (1 + greatest(r, 0)), 4) AS effective FROM a""",
    ),
    "block_means": (
        block_means,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(abs(target - prediction)) AS e FROM panel GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY session) - 1 AS p FROM s),
n AS (SELECT market, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT market, n, r AS replicate, unnest(range(CAST(ceil(n / 10.0) AS BIGINT))) AS block FROM n, range(10) t(r)),
d AS (SELECT market, CAST(replicate AS INTEGER) AS replicate, (replicate * 7919 + block * 104729) % (n - 9) + k AS p FROM b, range(10) u(k) WHERE block * 10 + k < n)
SELECT market, replicate, round(avg(e), 9) AS mean FROM d JOIN o USING (market, p) GROUP BY ALL""",
    ),
    "permutation_null": (
        permutation_null,
        f"""
WITH {PANEL_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY market, session ORDER BY l_orderkey, l_linenumber, target, prediction) AS i FROM panel),
t AS (SELECT market, session, k AS permutation, target AS other, row_number() OVER (PARTITION BY k, market, session ORDER BY sha256('perm' || k || ':' || l_orderkey || ':' || l_linenumber || ':' || session), target) AS i FROM panel, range(3) r(k))
SELECT market, CAST(permutation AS INTEGER) AS permutation, round(avg(abs(other - prediction)), 5) AS mae FROM b JOIN t USING (market, session, i) GROUP BY ALL""",
    ),
    "coverage_deviation": (
        coverage_deviation,
        f"""
WITH {PANEL_SQL}, c AS (SELECT year(session) AS y, market, count(*) AS n, count(*) FILTER (round(abs(target - prediction), 9) <= 0.05) AS k FROM panel GROUP BY ALL)
SELECT market, count(*) AS cells, round(avg(abs(k / n - 0.9)), 9) AS deviation FROM c GROUP BY ALL""",
    ),
    "action_grid": (
        action_grid,
        f"""
WITH {PANEL_SQL}, l AS (SELECT market, round((k - 10) * 0.005::DOUBLE, 6) AS action, avg(abs(round(target, 6) - round((k - 10) * 0.005::DOUBLE, 6))) AS loss FROM panel, range(21) t(k) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY round(loss, 9), action) AS r FROM l)
SELECT market, action, round(loss, 9) AS loss FROM r WHERE r = 1""",
    ),
    "asset_census": (
        asset_census,
        """
WITH h AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS k FROM orders GROUP BY ALL),
j AS (SELECT concat_ws('+', CASE WHEN orders IS NULL THEN 'orders' END, CASE WHEN coalesce(k, 0) = 0 THEN 'lines' END) AS missing, orders FROM customer LEFT JOIN h ON c_custkey = o_custkey)
SELECT missing, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS orders FROM j GROUP BY ALL""",
    ),
    "sector_lookup": (
        sector_lookup,
        """
WITH n AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5)
SELECT coalesce(r_name, 'unknown') AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN n ON c_nationkey = n_nationkey GROUP BY ALL""",
    ),
    "publication_instants": (
        publication_instants,
        """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
t AS (SELECT day, CAST(day + 1 AS TIMESTAMP) + INTERVAL 5 HOUR AS t FROM d)
SELECT day, t AS available_at, CAST(t + INTERVAL 8 HOUR AS DATE) AS shanghai_day, CAST(t - INTERVAL 5 HOUR AS DATE) AS york_day, CAST(date_trunc('month', day) AS DATE) AS month, CAST(day + INTERVAL 1 MONTH AS DATE) AS month_on FROM t""",
    ),
}
