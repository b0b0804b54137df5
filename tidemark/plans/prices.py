"""Queries over quotes: a user is an asset, its day's first, last, least and greatest event values a session's prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import prices as Q
from tidemark.session import table


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last are of the rows with a value; of equal times the smallest event_id counts, whatever the partitions."""
    e = table(spark, sf_dir, "events")
    there = F.col("value").isNotNull() & F.col("ts").isNotNull()
    first, last = F.when(there, F.struct("ts", "event_id")), F.when(there, F.struct("ts", F.bitwise_not("event_id")))
    return e.groupBy("user_id", (F.col("user_id") % 3).alias("market"), F.col("ts").cast("date").alias("day")).agg(
        F.min_by("value", first).alias("open"), F.max_by("value", last).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("volume")
    )


QUOTES = """q AS (SELECT user_id, user_id % 3 AS market, CAST(ts AS DATE) AS day, arg_min(value, ts) AS open, arg_max(value, ts) AS close, max(value) AS high, min(value) AS low, count(*) AS volume FROM events GROUP BY ALL)"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 40 = 0").select(F.col("event_type").alias("market"), F.col("ts").cast("date").alias("day"))


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()


def absent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a whole market lacks between its first and last."""
    return Q.absent_sessions(_calendar(spark, sf_dir), _sparse(spark, sf_dir), "market", "day")


def compressed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days with their position among those that a market has."""
    calendar = _calendar(spark, sf_dir)
    return Q.compressed(calendar, Q.absent_sessions(calendar, _sparse(spark, sf_dir), "market", "day"), "market", "day")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice") / F.when(F.col("o_orderkey") % 50 == 0, 1e6).otherwise(1.0)).alias("price"))
    return o.withColumn("price", F.when(F.col("o_orderkey") % 3 == 0, F.round(F.col("price") * 256) / 256).otherwise(F.col("price")))


def tick_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on the grid of their era against what chance would put there, by year."""
    o = _orders(spark, sf_dir).withColumn("ticks", Q.increments(F.col("day"), F.col("price")))
    return Q.concordance(o.withColumn("year", F.year("day")), ["year"], Q.on_grid(F.col("price"), F.col("ticks"), 2e-9), Q.chance(F.col("price"), F.col("ticks"), 2e-9))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes divided by an asset's own constant and the dividends still to come, as a vendor's adjustment does."""
    w = Window.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    q = quotes(spark, sf_dir).where("close >= 1").withColumn("offset", F.coalesce(F.sum(F.when(F.dayofmonth("day") % 10 == 0, 0.125).otherwise(0.0)).over(w), F.lit(0.0)))
    return q.withColumn("scaled", F.round("close", 2) / (1 + F.pmod("user_id", F.lit(5)) * 0.03 + F.col("offset")))


CANDIDATES = [1 + k * 0.01 for k in range(0, 21)]


def terminal_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant of each asset that puts its last closes on the grid, found again by search."""
    t = Q.terminal_constant(_scaled(spark, sf_dir), "user_id", "day", "scaled", "offset", F.array(F.lit(0.01)), F.array(*map(F.lit, CANDIDATES)), 8, 1e-7, 0.9, 0.25)
    return t.select("user_id", "rows", F.round("constant", 6).alias("constant"), "hits", "reason")


def unadjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as traded, reconstructed with the constant found: how many equal the closes they came from."""
    s = _scaled(spark, sf_dir)
    t = Q.terminal_constant(s, "user_id", "day", "scaled", "offset", F.array(F.lit(0.01)), F.array(*map(F.lit, CANDIDATES)), 8, 1e-7, 0.9, 0.25)
    j = s.join(t.select("user_id", "constant", "reason"), "user_id").withColumn("price", F.col("scaled") * (F.col("constant") + F.col("offset")))
    return j.groupBy(F.coalesce("reason", F.lit("found")).alias("state")).agg(F.countDistinct("user_id").alias("assets"), F.count(F.lit(1)).alias("rows"), F.count_if(F.round("price", 2) == F.round("close", 2)).alias("equal"))


def board_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes made of customers' keys by board, with the limit of a day that depends on them."""
    c = table(spark, sf_dir, "customer")
    prefix = F.get(F.array(*map(F.lit, ["600", "688", "000", "300", "900", "301"])), F.pmod("c_custkey", F.lit(6)).cast("int"))
    exchange = F.get(F.array(*map(F.lit, ["SH", "SS", "SZ", "SZ", "SS", "SZ"])), F.pmod("c_custkey", F.lit(6)).cast("int"))
    asset = F.concat(F.when(F.col("c_custkey") % 7 == 0, "CN/").otherwise(""), prefix, F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("."), exchange)
    day = F.date_add(F.lit("2006-01-01").cast("date"), (F.col("c_custkey") * 13 % 6500).cast("int"))
    c = c.select(Q.board(asset).alias("board"), day.alias("day"))
    return c.groupBy("board", Q.price_band(F.col("board"), F.col("day")).alias("band")).agg(F.count(F.lit(1)).alias("assets"), F.min("day").alias("first"))


def zone_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each calendar day's beginning in another zone, in microseconds."""
    return _calendar(spark, sf_dir).select("day", Q.day_start(F.col("day"), "Asia/Shanghai").alias("begins_us"))


def execution_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision's next session of its market and the asset's open there: decisions by whether they can be executed, and the mean gap."""
    q = quotes(spark, sf_dir)
    x = Q.executions(q.select("market", "user_id", "day", "close"), q, "market", "user_id", "day", ["open", "close"])
    limit = F.round(F.col("close").cast("decimal(18,4)") * F.lit("1.5").cast("decimal(3,1)"), 2).cast("double")
    state = F.when(F.col("execution_day").isNull(), "no_session").when(F.col("next_open").isNull(), "not_traded").when(F.col("next_open") > limit, "above_limit").otherwise("executed")
    return x.groupBy("market", state.alias("state")).agg(F.count(F.lit(1)).alias("decisions"), F.round(F.avg("next_open"), 6).alias("mean_open"), F.max(F.datediff("execution_day", "day")).alias("longest"))


def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known level of each market's index at or before each close, and the first day of an exact level from then on."""
    q = quotes(spark, sf_dir).groupBy("market", "day").agg(F.round(F.avg("close"), 6).alias("mean")).withColumn("level", F.when(F.dayofmonth("day") % 4 != 0, F.col("mean")))
    w = Window.partitionBy("market").orderBy("day")
    seen = F.last(F.when(F.col("level").isNotNull(), F.struct("day", "level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fill = F.first(F.when(F.col("level").isNotNull(), F.col("day")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return q.withColumns({"seen": seen, "first_fill": fill}).select("market", "day", F.col("seen.level").alias("level"), F.datediff("day", "seen.day").alias("age"), "first_fill")


def oracle_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each session: what the best rotation or holding could have made, the sum of logarithms up to it, and the capacity."""
    g = Q.growth_bounds(quotes(spark, sf_dir), "user_id", "day", "open", "close", "volume", 0.1)
    total = F.sum(F.log("growth")).over(Window.partitionBy(F.trunc("day", "MM")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("day", F.round("overnight", 6).alias("overnight"), F.round("intraday", 6).alias("intraday"), F.round("hold", 6).alias("hold"), F.round("growth", 6).alias("growth"), F.round("capacity", 5).alias("capacity"), F.round(total, 6).alias("log_growth"))


def regime_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of each market session from windows of five sessions."""
    return Q.regime_routes(quotes(spark, sf_dir), "market", "user_id", "day", "close", 5, 2, 3)


def placebo_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes against those of four sessions earlier: how often they agree."""
    r = regime_routes(spark, sf_dir).withColumn("placebo", F.lag("route", 4).over(Window.partitionBy("market").orderBy(F.asc_nulls_last("day"))))
    return r.where("placebo is not null").groupBy("market", "route", "placebo").agg(F.count(F.lit(1)).alias("sessions"))


def momentum_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's prediction: mean of centred ranks of the return up to a lag and of minus the return since."""
    w = Window.partitionBy("user_id").orderBy("day")
    q = quotes(spark, sf_dir).where("close > 0").withColumns({"a": F.lag("close", 5).over(w), "b": F.lag("close", 1).over(w)})
    q = q.withColumns({"momentum": F.round(F.log(F.col("b") / F.col("a")), 9), "reversal": F.round(-F.log(F.col("close") / F.col("b")), 9)})
    return q.select("user_id", "day", F.round(Q.momentum_reversal(q, ["market", "day"], "momentum", "reversal"), 7).alias("prediction"))


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the sessions of declared events, two before and three after."""
    ranges = spark.createDataFrame([("early", "2024-01-02", "2024-01-03"), ("middle", "2024-01-10", "2024-01-14"), ("late", "2024-01-29", "2024-02-10"), ("never", "2025-01-01", "2025-01-02")], "event string, first string, last string")
    ranges = ranges.withColumns({"first": F.col("first").cast("date"), "last": F.col("last").cast("date")})
    return Q.event_positions(Q.market_sessions(_sparse(spark, sf_dir), "market", "day"), ranges, "market", "day", 2, 3)


_SPARSE = "c AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), o AS (SELECT DISTINCT event_type AS market, CAST(ts AS DATE) AS day FROM events WHERE event_id % 40 = 0), s AS (SELECT market, min(day) AS a, max(day) AS b FROM o GROUP BY ALL), x AS (SELECT s.market, c.day FROM s, c WHERE c.day BETWEEN a AND b EXCEPT SELECT market, day FROM o)"
_SCALED = f"""{QUOTES}, f AS (SELECT user_id, day, close, coalesce(sum(CASE WHEN dayofmonth(day) % 10 = 0 THEN 0.125::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM q WHERE close >= 1),
g AS (SELECT *, round(close, 2) / (1 + (user_id % 5) * 0.03::DOUBLE + o) AS scaled, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM f),
h AS (SELECT user_id, 1 + k * 0.01::DOUBLE AS c, count(*) AS n, count(*) FILTER (abs(p - round_even(p / 0.01::DOUBLE, 0) * 0.01::DOUBLE) <= 1e-7 * p) AS hits FROM (SELECT user_id, k, scaled * (1 + k * 0.01::DOUBLE + o) AS p FROM g, range(21) t(k) WHERE r <= 8) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, c) AS i, coalesce(lead(hits) OVER (PARTITION BY user_id ORDER BY hits DESC, c), 0) AS second FROM h),
u AS (SELECT user_id, n, c, hits, CASE WHEN n < 8 THEN 'insufficient_rows' WHEN hits < 0.9 * n THEN 'no_grid_solution' WHEN hits - second < 0.25 * n THEN 'ambiguous' END AS reason FROM t WHERE i = 1)"""
_ROUTES = f"""{QUOTES}, d AS (SELECT market, day, row_number() OVER (PARTITION BY market ORDER BY day) - 1 AS place FROM (SELECT DISTINCT market, day FROM q)),
l AS (SELECT q.market, user_id, place, ln(close) AS l FROM q JOIN d USING (market, day)),
w AS (SELECT a.market, a.user_id, a.place, b.place - a.place + 4 AS k, b.l FROM l a JOIN l b ON b.user_id = a.user_id AND b.place BETWEEN a.place - 4 AND a.place),
v AS (SELECT *, count(*) OVER (PARTITION BY user_id, place) AS n, lag(l) OVER (PARTITION BY user_id, place ORDER BY k) AS before FROM w),
m AS (SELECT market, place, k, median(l - before) AS m FROM v WHERE n = 5 AND k > 0 GROUP BY ALL),
y AS (SELECT market, place, sqrt(avg(m * m) FILTER (k >= 3)) AS recent, sqrt(avg(m * m) FILTER (k < 3)) AS earlier FROM m GROUP BY ALL),
z AS (SELECT market, place, count(*) AS assets, median(t) AS trend FROM (SELECT market, place, user_id, max(l) FILTER (k = 4) - max(l) FILTER (k = 0) AS t FROM v WHERE n = 5 GROUP BY ALL) GROUP BY ALL),
routes AS (SELECT d.market, d.day, coalesce(assets, 0) AS assets, CAST(CASE WHEN coalesce(assets, 0) >= 3 THEN 1 + CASE WHEN round(trend, 9) > 0 THEN 0 ELSE 1 END + CASE WHEN round(recent - earlier, 9) > 0 THEN 2 ELSE 0 END ELSE 0 END AS INTEGER) AS route
  FROM d LEFT JOIN z USING (market, place) LEFT JOIN y USING (market, place))"""


REGISTERED = {
    "absent_sessions": (absent_sessions, f"WITH {_SPARSE} SELECT market, day FROM x"),
    "compressed_positions": (
        compressed_positions,
        f"""
WITH {_SPARSE}, e AS (SELECT m.market, c.day, x.day IS NOT NULL AS gone FROM (SELECT DISTINCT market FROM x) m CROSS JOIN c LEFT JOIN x ON x.market = m.market AND x.day = c.day)
SELECT market, day, CASE WHEN NOT gone THEN CAST(count(*) FILTER (NOT gone) OVER (PARTITION BY market ORDER BY day) - 1 AS BIGINT) END AS position FROM e""",
    ),
    "tick_concordance": (
        tick_concordance,
        f"""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_totalprice / CASE WHEN o_orderkey % 50 = 0 THEN 1e6 ELSE 1 END AS p FROM orders),
p AS (SELECT day, CASE WHEN k % 3 = 0 THEN round(p * 256) / 256 ELSE p END AS p FROM o),
t AS (SELECT *, CASE WHEN day < DATE '{Q.COMPLETE}' THEN 1 / 256.0::DOUBLE END AS a, CASE WHEN day >= DATE '{Q.COMPLETE}' AND p < 1 THEN 0.0001::DOUBLE WHEN day >= DATE '{Q.PILOT}' THEN 0.01::DOUBLE END AS b FROM p),
h AS (SELECT CAST(year(day) AS INTEGER) AS year, coalesce(abs(p - round_even(p / a, 0) * a) <= 2e-9 * p, false) OR coalesce(abs(p - round_even(p / b, 0) * b) <= 2e-9 * p, false) AS hit, least(1, coalesce(4e-9 * p / a, 0) + coalesce(4e-9 * p / b, 0)) AS c FROM t),
g AS (SELECT year, count(*) AS rows, count(*) FILTER (hit) AS on_grid, avg(c) AS c FROM h GROUP BY ALL)
SELECT year, rows, on_grid, round(on_grid / rows, 7) AS rate, round(c, 7) AS chance, CASE WHEN c < 1 THEN round((on_grid / rows - c) / (1 - c), 7) END AS excess FROM g""",
    ),
    "terminal_constants": (terminal_constants, f"WITH {_SCALED} SELECT user_id, n AS rows, CASE WHEN reason IS NULL THEN round(c, 6) END AS constant, hits, reason FROM u"),
    "unadjusted_prices": (
        unadjusted_prices,
        f"""
WITH {_SCALED}, j AS (SELECT g.user_id, close, reason, CASE WHEN reason IS NULL THEN scaled * (c + o) END AS price FROM g JOIN u ON u.user_id = g.user_id)
SELECT coalesce(reason, 'found') AS state, count(DISTINCT user_id) AS assets, count(*) AS rows, count(*) FILTER (round(price, 2) = round(close, 2)) AS equal FROM j GROUP BY ALL""",
    ),
    "board_rules": (
        board_rules,
        """
WITH c AS (SELECT CASE c_custkey % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'star' WHEN 2 THEN 'main' WHEN 3 THEN 'chinext' WHEN 5 THEN 'chinext' END AS board, DATE '2006-01-01' + CAST(c_custkey * 13 % 6500 AS INTEGER) AS day FROM customer)
SELECT board, CASE WHEN board IN ('main', 'chinext') AND day >= DATE '2006-07-01' AND day < DATE '2024-01-01' THEN CASE WHEN board = 'chinext' AND day >= DATE '2020-08-24' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END
  WHEN board = 'star' AND day >= DATE '2019-07-22' AND day < DATE '2024-01-01' THEN 0.2::DOUBLE END AS band, count(*) AS assets, min(day) AS first FROM c GROUP BY ALL""",
    ),
    "zone_days": (zone_days, "SELECT DISTINCT CAST(ts AS DATE) AS day, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR) AS begins_us FROM events"),
    "execution_prices": (
        execution_prices,
        f"""
WITH {QUOTES}, d AS (SELECT DISTINCT market, day FROM q), n AS (SELECT market, day, lead(day) OVER (PARTITION BY market ORDER BY day) AS x FROM d),
j AS (SELECT q.market, q.day, q.close, n.x, e.open AS next_open FROM q JOIN n ON n.market = q.market AND n.day = q.day LEFT JOIN q e ON e.user_id = q.user_id AND e.day = n.x)
SELECT market, CASE WHEN x IS NULL THEN 'no_session' WHEN next_open IS NULL THEN 'not_traded' WHEN next_open > CAST(round(CAST(close AS DECIMAL(18, 4)) * 1.5, 2) AS DOUBLE) THEN 'above_limit' ELSE 'executed' END AS state,
  count(*) AS decisions, round(avg(next_open), 6) AS mean_open, CAST(max(x - day) AS INTEGER) AS longest FROM j GROUP BY ALL""",
    ),
    "index_levels": (
        index_levels,
        f"""
WITH {QUOTES}, m AS (SELECT market, day, round(avg(close), 6) AS level FROM q GROUP BY ALL), l AS (SELECT market, day, CASE WHEN dayofmonth(day) % 4 <> 0 THEN level END AS level FROM m),
s AS (SELECT a.market, a.day, (SELECT max(b.day) FROM l b WHERE b.market = a.market AND b.day <= a.day AND b.level IS NOT NULL) AS seen, (SELECT min(b.day) FROM l b WHERE b.market = a.market AND b.day >= a.day AND b.level IS NOT NULL) AS first_fill FROM l a)
SELECT s.market, s.day, l.level, CAST(s.day - seen AS INTEGER) AS age, first_fill FROM s LEFT JOIN l ON l.market = s.market AND l.day = seen""",
    ),
    "oracle_growth": (
        oracle_growth,
        f"""
WITH {QUOTES}, b AS (SELECT *, lag(close) OVER w AS before, lag(volume) OVER w AS v FROM q WINDOW w AS (PARTITION BY user_id ORDER BY day)),
g AS (SELECT day, greatest(coalesce(max(CASE WHEN open > 0 AND before > 0 THEN open / before END), 1), 1) AS overnight, greatest(coalesce(max(CASE WHEN close > 0 AND open > 0 THEN close / open END), 1), 1) AS intraday,
  greatest(coalesce(max(CASE WHEN close > 0 AND before > 0 THEN close / before END), 1), 1) AS hold, coalesce(sum(CASE WHEN open > 0 THEN 0.1 * v * open END), 0) AS capacity FROM b GROUP BY ALL),
h AS (SELECT *, greatest(overnight * intraday, hold) AS growth FROM g)
SELECT day, round(overnight, 6) AS overnight, round(intraday, 6) AS intraday, round(hold, 6) AS hold, round(growth, 6) AS growth, round(capacity, 5) AS capacity, round(sum(ln(growth)) OVER (PARTITION BY date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS log_growth FROM h""",
    ),
    "regime_routes": (regime_routes, f"WITH {_ROUTES} SELECT market, day, assets, route FROM routes"),
    "placebo_routes": (
        placebo_routes,
        f"WITH {_ROUTES}, p AS (SELECT *, lag(route, 4) OVER (PARTITION BY market ORDER BY day) AS placebo FROM routes) SELECT market, route, placebo, count(*) AS sessions FROM p WHERE placebo IS NOT NULL GROUP BY ALL",
    ),
    "momentum_reversal": (
        momentum_reversal,
        f"""
WITH {QUOTES}, l AS (SELECT *, lag(close, 5) OVER w AS a, lag(close, 1) OVER w AS b FROM q WHERE close > 0 WINDOW w AS (PARTITION BY user_id ORDER BY day)),
v AS (SELECT *, round(ln(b / a), 9) AS m, round(-ln(close / b), 9) AS r FROM l),
c AS (SELECT user_id, day, m, r, count(m) OVER s AS nm, count(r) OVER s AS nr, rank() OVER (PARTITION BY market, day, m IS NULL ORDER BY m) + (count(*) OVER (PARTITION BY market, day, m) - 1) / 2.0 AS rm,
  rank() OVER (PARTITION BY market, day, r IS NULL ORDER BY r) + (count(*) OVER (PARTITION BY market, day, r) - 1) / 2.0 AS rr FROM v WINDOW s AS (PARTITION BY market, day)),
x AS (SELECT user_id, day, CASE WHEN m IS NOT NULL THEN CASE WHEN nm > 1 THEN (rm - 1) / (nm - 1) - 0.5 ELSE 0 END END AS a, CASE WHEN r IS NOT NULL THEN CASE WHEN nr > 1 THEN (rr - 1) / (nr - 1) - 0.5 ELSE 0 END END AS b FROM c)
SELECT user_id, day, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 ELSE (coalesce(a, 0) + coalesce(b, 0)) / (CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER)) END, 7)::DOUBLE AS prediction FROM x""",
    ),
    "event_positions": (
        event_positions,
        f"""
WITH {_SPARSE}, p AS (SELECT market, day, CAST(row_number() OVER (PARTITION BY market ORDER BY day) - 1 AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY market) - 1 AS INTEGER) AS most FROM o),
r(event, f, l) AS (VALUES ('early', DATE '2024-01-02', DATE '2024-01-03'), ('middle', DATE '2024-01-10', DATE '2024-01-14'), ('late', DATE '2024-01-29', DATE '2024-02-10'), ('never', DATE '2025-01-01', DATE '2025-01-02'))
SELECT event, market, count(*) AS sessions, greatest(min(place) - 2, 0) AS from_place, least(max(place) + 3, max(most)) AS to_place FROM p JOIN r ON day BETWEEN f AND l GROUP BY ALL""",
    ),
}
