"""Queries over events: time joins, trailing features, windows and drawdowns; users are assets, days sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import relational as R
from tidemark.session import instants, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count of values per user and day."""
    return events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("value"), F.count(F.lit(1)).alias("volume"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_grid(daily(spark, sf_dir), ["user_id"], "day")


DAILY = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS value, count(*) AS volume FROM events GROUP BY ALL)"
GRID = f"""{DAILY}, s AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY user_id),
g AS (SELECT s.user_id, s.day, d.value, d.volume FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.day = s.day)"""


def by_day():
    return Window.partitionBy("user_id").orderBy("day")


def asof_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every signup the user's latest purchase at or before it, its value (NULL stays NULL) and its age."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'signup'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.when(F.col("value") > 5, F.col("value")).alias("value")).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    found = R.asof_join(left, right, "ts", ["user_id"], ["value"], "last_")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))
    return found.select("event_id", "user_id", "last_at", "last_value", F.round(age / 1e6, 6).alias("age_seconds"))


def range_news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every signup the user's clicks of the 48 hours up to it: count, sum and latest."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'signup'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "value")
    pairs = R.interval_join(left, right, ["user_id"], "ts", "at", 48 * 3600)
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("clicks"), F.round(F.sum("value"), 6).alias("total"), F.max("at").alias("latest"))


def trailing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, guarded trailing mean and maximum on the dense grid of days."""
    w5 = C.trailing(by_day(), 5)
    n = F.count("value").over(w5)
    g = grid(spark, sf_dir)
    return g.select(
        "user_id", "day", F.lag("value", 1).over(by_day()).alias("lag_1"), F.lag("value", 5).over(by_day()).alias("lag_5"),
        F.round(C.guarded(F.avg("value").over(w5), n, 4), 9).alias("mean_5"),
        C.guarded(F.max("value").over(C.trailing(by_day(), 10)), F.count("value").over(C.trailing(by_day(), 10)), 8).alias("max_10"),
        F.round(C.safe_ratio(F.col("value"), F.max("value").over(C.trailing(by_day(), 10))), 9).alias("distance_to_high"),
        F.row_number().over(by_day()).alias("place"),
    )


def last_valid_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill over at most two days."""
    return R.last_valid(grid(spark, sf_dir), ["user_id"], "day", "value", 2, "filled").select("user_id", "day", "value", "filled")


def residual_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual deviation of the user's daily value on the market's mean value, over the last ten days."""
    d = daily(spark, sf_dir)
    market = d.groupBy("day").agg(F.avg("value").alias("market"))
    rows = d.join(F.broadcast(market), "day")  # a row for each day
    return rows.select("user_id", "day", F.round(C.ols_residual_std("value", "market", C.trailing(by_day(), 10)), 5).alias("residual_std"), F.count("value").over(C.trailing(by_day(), 10)).alias("n"))


def liquidity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four strata of users per day by the median volume of a complete window of five rows."""
    d = daily(spark, sf_dir)
    w = C.trailing(by_day(), 5)
    d = d.withColumn("liquidity", C.guarded(F.percentile("volume", 0.5).over(w), F.count("volume").over(w), 5)).where("liquidity is not null")
    day = Window.partitionBy("day")
    place = F.rank().over(day.orderBy("liquidity")) - 1
    return d.select("user_id", "day", "liquidity", F.floor(place * 4 / F.count(F.lit(1)).over(day)).cast("int").alias("code"))


def drawdown_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative return, volatility and drawdown of a path of log returns per user."""
    rows = daily(spark, sf_dir).withColumn("r", (F.col("value") - 60) / 1000)
    return R.running_drawdown(rows, ["user_id"], "day", "r")


def market_regime_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of the user's values of the last 24 hours, at each event."""
    e = instants(events(spark, sf_dir), "ts").withColumn("us", F.unix_micros("ts"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000 + 1, 0)
    return e.select("event_id", F.round(F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)), 7).alias("rms"), F.count(F.lit(1)).over(w).alias("n"))


def suffix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of the factors strictly after each day."""
    rows = daily(spark, sf_dir).select("user_id", "day", (1 + F.pmod(F.col("volume"), F.lit(3)) * 0.5).alias("factor"))
    return R.suffix_product(rows, ["user_id"], "day", "factor", "multiplier").select("user_id", "day", F.round("multiplier", 6).alias("multiplier"))


def suffix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over later days of dividend over the previous value; an invalid value poisons all earlier days."""
    rows = daily(spark, sf_dir).withColumn("term", F.when(F.lag("value").over(by_day()) > 1, F.lit(0.01) / F.lag("value").over(by_day())).otherwise(F.lit(None)))
    later = by_day().rowsBetween(1, Window.unboundedFollowing)
    bad = F.sum(F.col("term").isNull().cast("int")).over(later)
    return rows.select("user_id", "day", F.when(F.coalesce(bad, F.lit(0)) == 0, F.round(F.coalesce(F.sum("term").over(later), F.lit(0.0)), 9)).alias("offset"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: runs of events with gaps under six hours."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events(spark, sf_dir).withColumn("starts", F.coalesce(gap > 6 * 3_600_000_000, F.lit(True)))
    rows = R.runs(rows, ["user_id"], ["ts", "event_id"], F.col("starts"), "session")
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and values by type and six hours."""
    e = instants(events(spark, sf_dir), "ts").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "total")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of two hours that begin every hour."""
    e = instants(events(spark, sf_dir), "ts").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events")


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the events' JSON properties by state."""
    k = F.get_json_object("props", "$.k")
    return events(spark, sf_dir).select("event_type", C.number_state(k).alias("state"), C.exact_double(k).alias("k")).groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total"), F.max("k").alias("most"))


def recent_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user, and in how many types."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("types"), F.round(F.avg("value"), 9).alias("mean"))


def write_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and type the ten events of the smallest priority (minus value, then id)."""
    w = Window.partitionBy("day", "event_type").orderBy(F.desc("value"), "event_id")
    rows = events(spark, sf_dir).withColumn("day", F.col("ts").cast("date")).withColumn("r", F.row_number().over(w))
    return rows.where("r <= 10").groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("written"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least"))


def periodic_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five days per type: the 90 percent order statistic of values of the fifteen days before the block."""
    e = events(spark, sf_dir).select("event_type", F.col("ts").cast("date").alias("day"), "value")
    days = e.select("event_type", "day").distinct().withColumn("block", F.floor((F.row_number().over(Window.partitionBy("event_type").orderBy("day")) - 1) / 5))
    starts = days.groupBy("event_type", "block").agg(F.min("day").alias("start"))
    # a start asks for fifteen days, so that the join is one on days and doesn't grow with the span
    asked = starts.withColumn("day", F.explode(F.sequence(F.date_sub("start", 15), F.date_sub("start", 1))))
    pool = e.join(asked, ["event_type", "day"])
    found = R.order_statistic(pool, ["event_type", "block"], "value", C.ceil_percent(F.col("_n") + 1, 90), "radius")
    return found.where("n >= 20").select("event_type", "block", "n", "radius")


def reappearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event type per user: first visits and revisits, and sessions since last seen."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumn("step", F.row_number().over(w)).withColumn("changed", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    seen = F.lag("step").over(Window.partitionBy("user_id", "event_type").orderBy("step"))
    e = e.withColumn("absence", F.col("step") - seen)
    kind = F.when(~F.col("changed"), "continuing").when(F.col("absence").isNull(), "novel").otherwise("revisit")
    return e.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("events"), F.max("absence").alias("longest"), F.round(F.avg("absence"), 6).alias("mean_absence"))


def pbo_cscv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six blocks of days, all halves: the in-sample best type's rank out of sample."""
    from itertools import combinations

    e = events(spark, sf_dir).select("event_type", F.pmod(F.dayofyear("ts"), F.lit(6)).alias("block"), "value")
    blocks = e.groupBy("event_type", "block").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    halves = spark.createDataFrame([(k, b, b in c) for k, c in enumerate(combinations(range(6), 3)) for b in range(6)], "combo int, block int, inside boolean")
    stats = blocks.join(F.broadcast(halves), "block").groupBy("combo", "event_type").agg((F.sum(F.when(F.col("inside"), F.col("s"))) / F.sum(F.when(F.col("inside"), F.col("n")))).alias("a"), (F.sum(F.when(~F.col("inside"), F.col("s"))) / F.sum(F.when(~F.col("inside"), F.col("n")))).alias("b"))
    w = Window.partitionBy("combo")
    stats = stats.withColumn("best", F.row_number().over(w.orderBy(F.desc(F.round("a", 9)), "event_type"))).withColumn("out_rank", F.rank().over(w.orderBy(F.round("b", 9))))
    return stats.where("best = 1").select("combo", "event_type", F.round("a", 7).alias("inside_mean"), "out_rank")


REGISTERED = {
    "asof_context": (
        asof_context,
        """
WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
r AS (SELECT user_id, ts AS at_ts, max(CASE WHEN value > 5 THEN value END) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT l.event_id, l.user_id, r.at_ts AS last_at, r.value AS last_value, round((epoch_us(l.ts) - epoch_us(r.at_ts)) / 1e6, 6) AS age_seconds
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at_ts""",
    ),
    "range_news_window": (
        range_news_window,
        """
SELECT l.event_id, count(*) AS clicks, round(sum(r.value), 6) AS total, max(r.ts) AS latest
FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts > l.ts - INTERVAL 48 HOUR AND r.ts <= l.ts
WHERE l.event_type = 'signup' AND r.event_type = 'click' GROUP BY ALL""",
    ),
    "trailing_features": (
        trailing_features,
        f"""
WITH {GRID} SELECT user_id, day, lag(value, 1) OVER w AS lag_1, lag(value, 5) OVER w AS lag_5,
  CASE WHEN count(value) OVER w5 >= 4 THEN round(avg(value) OVER w5, 9) END AS mean_5,
  CASE WHEN count(value) OVER w10 >= 8 THEN max(value) OVER w10 END AS max_10,
  CASE WHEN max(value) OVER w10 <> 0 THEN round(value / max(value) OVER w10, 9) END AS distance_to_high, CAST(row_number() OVER w AS INTEGER) AS place
FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day), w5 AS (PARTITION BY user_id ORDER BY day ROWS 4 PRECEDING), w10 AS (PARTITION BY user_id ORDER BY day ROWS 9 PRECEDING)""",
    ),
    "last_valid_tolerance": (
        last_valid_tolerance,
        f"""
WITH {GRID}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS p FROM g),
f AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER w AS q, last_value(value IGNORE NULLS) OVER w AS v FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT user_id, day, value, CASE WHEN p - q <= 2 THEN v END AS filled FROM f""",
    ),
    "residual_ols": (
        residual_ols,
        f"""
WITH {DAILY}, m AS (SELECT day, avg(value) AS market FROM d GROUP BY ALL),
r AS (SELECT d.user_id, d.day, d.value AS y, m.market AS x FROM d JOIN m USING (day)),
s AS (SELECT user_id, day, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS xx, sum(y * y) OVER w AS yy, sum(x * y) OVER w AS xy FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 9 PRECEDING))
SELECT user_id, day, CASE WHEN n > 2 AND xx - sx * sx / n > 1e-9 THEN round(sqrt(greatest(yy - sy * sy / n - pow(xy - sx * sy / n, 2) / (xx - sx * sx / n), 0) / (n - 2)), 5) END AS residual_std, n FROM s""",
    ),
    "liquidity_codes": (
        liquidity_codes,
        f"""
WITH {DAILY}, l AS (SELECT user_id, day, CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(volume, 0.5) OVER w END AS liquidity FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 4 PRECEDING)),
k AS (SELECT * FROM l WHERE liquidity IS NOT NULL)
SELECT user_id, day, liquidity, CAST(floor((rank() OVER (PARTITION BY day ORDER BY liquidity) - 1) * 4 / count(*) OVER (PARTITION BY day)) AS INTEGER) AS code FROM k""",
    ),
    "drawdown_stats": (
        drawdown_stats,
        f"""
WITH {DAILY}, r AS (SELECT user_id, day, (value - 60) / 1000 AS r FROM d),
c AS (SELECT *, sum(r) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum FROM r),
p AS (SELECT *, greatest(max(cum) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS peak FROM c)
SELECT user_id, count(*) AS n, round(exp(sum(r)) - 1, 9) AS cumulative, round(stddev_samp(r), 9) AS volatility, round(max(1 - exp(cum - peak)), 9) AS max_drawdown FROM p GROUP BY ALL""",
    ),
    "market_regime_rms": (
        market_regime_rms,
        """
SELECT event_id, round(sqrt(avg(value * value) OVER w), 7) AS rms, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
    ),
    "suffix_product": (
        suffix_product,
        f"""
WITH {DAILY} SELECT user_id, day, round(coalesce(product(1 + volume % 3 * 0.5) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 6) AS multiplier FROM d""",
    ),
    "suffix_offsets": (
        suffix_offsets,
        f"""
WITH {DAILY}, t AS (SELECT user_id, day, CASE WHEN lag(value) OVER w > 1 THEN 0.01 / lag(value) OVER w END AS term FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
s AS (SELECT user_id, day, sum(term) OVER w AS s, sum(CASE WHEN term IS NULL THEN 1 ELSE 0 END) OVER w AS bad FROM t WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, day, CASE WHEN coalesce(bad, 0) = 0 THEN round(coalesce(s, 0), 9) END AS "offset" FROM s""",
    ),
    "session_windows": (
        session_windows,
        """
WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, true) AS starts FROM events),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL""",
    ),
    "tumbling_windows": (tumbling_windows, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL"),
    "sliding_windows": (
        sliding_windows,
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS events FROM events, range(2) t(k) GROUP BY ALL",
    ),
    "props_json": (
        props_json,
        """
WITH k AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events),
s AS (SELECT event_type, CASE WHEN k IS NULL THEN 'absent' WHEN regexp_full_match(k, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'number' ELSE 'invalid' END AS state, k FROM k)
SELECT event_type, state, count(*) AS events, sum(CASE WHEN state = 'number' THEN CAST(k AS DOUBLE) END) AS total, max(CASE WHEN state = 'number' THEN CAST(k AS DOUBLE) END) AS most FROM s GROUP BY ALL""",
    ),
    "recent_mentions": (
        recent_mentions,
        """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS types, round(avg(value), 9) AS mean FROM r WHERE r <= 3 GROUP BY ALL""",
    ),
    "write_budget": (
        write_budget,
        """
WITH r AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT day, event_type, count(*) AS written, round(sum(value), 6) AS total, min(value) AS least FROM r WHERE r <= 10 GROUP BY ALL""",
    ),
    "periodic_refit": (
        periodic_refit,
        """
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, value FROM events),
u AS (SELECT DISTINCT event_type, day FROM e),
b AS (SELECT event_type, day, (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1) // 5 AS block FROM u),
s AS (SELECT event_type, block, min(day) AS start FROM b GROUP BY ALL),
p AS (SELECT s.event_type, s.block, e.value, row_number() OVER w AS r, count(*) OVER (PARTITION BY s.event_type, s.block) AS n FROM s JOIN e ON s.event_type = e.event_type AND e.day < s.start AND e.day >= s.start - 15 WINDOW w AS (PARTITION BY s.event_type, s.block ORDER BY e.value))
SELECT event_type, block, n, value AS radius FROM p WHERE r = ((n + 1) * 90 + 99) // 100 AND n >= 20""",
    ),
    "reappearance": (
        reappearance,
        """
WITH s AS (SELECT *, row_number() OVER w AS step, event_type IS DISTINCT FROM lag(event_type) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT *, step - lag(step) OVER (PARTITION BY user_id, event_type ORDER BY step) AS absence FROM s)
SELECT CASE WHEN NOT changed THEN 'continuing' WHEN absence IS NULL THEN 'novel' ELSE 'revisit' END AS kind, count(*) AS events, max(absence) AS longest, round(avg(absence), 6) AS mean_absence FROM a GROUP BY ALL""",
    ),
    "pbo_cscv": (
        pbo_cscv,
        """
WITH b AS (SELECT event_type, dayofyear(ts) % 6 AS block, sum(value) AS s, count(*) AS n FROM events GROUP BY ALL),
h AS (SELECT CAST(row_number() OVER (ORDER BY x, y, z) - 1 AS INTEGER) AS combo, x, y, z FROM range(6) a(x), range(6) b(y), range(6) c(z) WHERE x < y AND y < z),
t AS (SELECT combo, event_type, sum(s) FILTER (block IN (x, y, z)) / sum(n) FILTER (block IN (x, y, z)) AS a, sum(s) FILTER (block NOT IN (x, y, z)) / sum(n) FILTER (block NOT IN (x, y, z)) AS b FROM b, h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY round(a, 9) DESC, event_type) AS best, CAST(rank() OVER (PARTITION BY combo ORDER BY round(b, 9)) AS INTEGER) AS out_rank FROM t)
SELECT combo, event_type, round(a, 7) AS inside_mean, out_rank FROM r WHERE best = 1""",
    ),
}
