"""Queries over resampled series: session errors by market, arms that scale the prediction, drawn by a fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import resampling as B
from tidemark.plans.panel import KEYS, PANEL_SQL, panel
from tidemark.plans.timeline import DAILY, daily

ARMS = {"base": 1.0, "half": 0.5, "tenth": 0.1, "flip": -1.0}
REPLICATES, BLOCK = 12, 20


def arm_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of each arm, market and session."""
    rows = panel(spark, sf_dir).select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.lit(f).alias("factor")) for n, f in ARMS.items()])).alias("a")).select("market", "session", "target", "prediction", "a.*")
    return rows.groupBy("arm", *KEYS).agg(F.avg(F.abs(F.col("target") - F.col("prediction") * F.col("factor"))).alias("e"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the drawn sessions, with repeats: arm, market, replicate, at, e."""
    s = B.placed(arm_errors(spark, sf_dir), ["arm", "market"], "session")
    sizes = s.where("arm = 'base'").select("market", "length").distinct()
    draws = B.circular_draws(sizes, ["market"], "length", REPLICATES, BLOCK, F.col("replicate") * 7919 + F.col("number") * 104729)
    return s.join(draws, ["market", "place"])


def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates drawn within each market; a replicate's mean weighs the markets by their sessions."""
    d = _drawn(spark, sf_dir).where("arm = 'base'")
    m = d.groupBy("replicate", "market").agg(F.avg("e").alias("e"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("replicate").agg(F.round(F.sum(F.col("e") * F.col("n")) / F.sum("n"), 9).alias("mean"), F.sum("n").alias("sessions"))


def relative_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's relative difference to the base, by replicate and market, on the same draws."""
    m = _drawn(spark, sf_dir).groupBy("replicate", "market").agg(*[F.avg(F.when(F.col("arm") == a, F.col("e"))).alias(a) for a in ARMS])
    return m.select("replicate", "market", *[F.round((F.col(a) - F.col("base")) / F.col("base"), 7).alias(a) for a in ARMS if a != "base"])


def family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arm against the base: simultaneous intervals and step-down p-values from the shared draws."""
    m = _drawn(spark, sf_dir).groupBy("replicate", "arm").agg(F.avg("e").alias("e"))
    base = m.where("arm = 'base'").select("replicate", F.col("e").alias("b"))
    draws = m.where("arm <> 'base'").join(base, "replicate").select("replicate", "arm", (F.col("e") - F.col("b")).alias("d"))
    t = arm_errors(spark, sf_dir).groupBy("arm").agg(F.avg("e").alias("e"))
    estimates = t.where("arm <> 'base'").crossJoin(F.broadcast(t.where("arm = 'base'").select(F.col("e").alias("b")))).select("arm", (F.col("e") - F.col("b")).alias("estimate"))
    f = B.step_down(estimates, draws, "arm", "replicate", "d", 0.9)
    return f.select("arm", "rank", *[F.round(c, 7).alias(c) for c in ("estimate", "deviation", "low", "high", "p_value")])


def seed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arms' percentile intervals say of them under three kinds of question and a band of seed variance."""
    m = _drawn(spark, sf_dir).groupBy("replicate", "arm").agg(F.avg("e").alias("e"))
    base = m.where("arm = 'base'").select("replicate", F.col("e").alias("b"))
    i = m.where("arm <> 'base'").join(base, "replicate").groupBy("arm").agg(F.percentile(F.col("e") - F.col("b"), 0.05).alias("low"), F.percentile(F.col("e") - F.col("b"), 0.95).alias("high"))
    band = F.when(F.col("arm") == "tenth", 1.0).otherwise(0.00001)
    return i.select("arm", *[B.decision(k, F.col("low"), F.col("high"), band, 0.003, 0.004).alias(k) for k in ("superiority", "non_inferiority", "equivalence")])


def linear_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sums of arms by market; one names an arm that isn't there."""
    c = spark.createDataFrame([("halving", "half", 1.0), ("halving", "base", -1.0), ("curve", "base", 1.0), ("curve", "half", -2.0), ("curve", "tenth", 1.0), ("broken", "base", 1.0), ("broken", "absent", -1.0)], "contrast string, arm string, coefficient double")
    v = arm_errors(spark, sf_dir).groupBy("market", "arm").agg(F.avg("e").alias("e"))
    return B.contrasts(v, ["market"], "arm", "e", c).select("market", "contrast", F.round("value", 9).alias("value"))


PARTS = ["level", "scale", "sign"]


def _coalitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worth of every set of three changes to the prediction: minus the session-weighted error."""
    from itertools import combinations

    sets = ["+".join(s) for k in range(4) for s in combinations(PARTS, k)]
    rows = panel(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, sets))).alias("coalition"))
    p = F.col("prediction")
    p = F.when(F.contains("coalition", F.lit("scale")), p * 0.4).otherwise(p)
    p = p + F.when(F.contains("coalition", F.lit("level")), 0.004).otherwise(0.0)
    p = F.when(F.contains("coalition", F.lit("sign")) & (F.col("l_linenumber") % 2 == 0), -p).otherwise(p)
    s = rows.groupBy("coalition", *KEYS).agg(F.avg(F.abs(F.col("target") - p)).alias("e"))
    return s.groupBy("coalition").agg((-F.avg("e")).alias("worth"))


def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change's share of what all three together change."""
    w = spark.createDataFrame(B.shapley_weights(PARTS), "component string, coalition string, weight double")
    return _coalitions(spark, sf_dir).join(F.broadcast(w), "coalition").groupBy("component").agg(F.round(F.sum(F.col("weight") * F.col("worth")), 9).alias("value"))


def factorial_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main effects and interactions of the three changes."""
    w = spark.createDataFrame(B.factorial_effects(PARTS), "effect string, coalition string, coefficient double")
    return _coalitions(spark, sf_dir).join(F.broadcast(w), "coalition").groupBy("effect").agg(F.round(F.sum(F.col("coefficient") * F.col("worth")), 9).alias("value"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's log returns: the change of the logarithm of one plus the day's value, a hundredth of it."""
    w = Window.partitionBy("user_id").orderBy("day")
    d = daily(spark, sf_dir).withColumn("r", (F.log1p("value") - F.lag(F.log1p("value")).over(w)) / 100)
    return d.where("r is not null").select("user_id", "day", "r")


def portfolio_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each user's path."""
    s = B.path_statistics(_returns(spark, sf_dir), ["user_id"], "day", "r", 252)
    return s.select("user_id", "n", *[F.round(c, 7).alias(c) for c in ("cumulative", "annual", "volatility", "sharpe", "sortino", "max_drawdown")])


def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's net asset value by day, costs of turnover taken off, as returns and their statistics."""
    w = Window.partitionBy("user_id").orderBy("day")
    d = daily(spark, sf_dir).withColumn("turnover", F.abs(F.col("volume") - F.coalesce(F.lag("volume").over(w), F.lit(0))))
    d = d.withColumn("nav", 1000 + F.sum(F.col("value") - 0.5 * F.col("turnover")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("r", F.log(F.col("nav") / F.coalesce(F.lag("nav").over(w), F.lit(1000.0))))
    s = B.path_statistics(d, ["user_id"], "day", "r", 252).join(d.groupBy("user_id").agg(F.sum("turnover").alias("turnover"), F.round(F.max_by("nav", "day"), 6).alias("final")), "user_id")
    return s.select("user_id", "n", "turnover", "final", F.round("cumulative", 7).alias("cumulative"), F.round("sharpe", 6).alias("sharpe"), F.round("max_drawdown", 7).alias("max_drawdown"))


def resampled_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each user's path under resampled orders of its days."""
    s = B.placed(_returns(spark, sf_dir), ["user_id"], "day")
    draws = B.circular_draws(s.select("user_id", "length").distinct(), ["user_id"], "length", 4, 5, F.col("replicate") * 31 + F.col("number") * 17 + F.col("user_id"))
    path = s.join(draws, ["user_id", "place"])
    p = B.path_statistics(path, ["user_id", "replicate"], "at", "r", 252)
    return p.groupBy("replicate").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("cumulative"), 7).alias("cumulative"), F.round(F.avg("sharpe"), 6).alias("sharpe"), F.round(F.max("max_drawdown"), 7).alias("max_drawdown"))


ERRORS = f"""{PANEL_SQL}, e AS (SELECT arm, market, session, avg(abs(target - prediction * f)) AS e FROM panel, (VALUES {', '.join(f"('{n}', {f}::DOUBLE)" for n, f in ARMS.items())}) v(arm, f) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY arm, market ORDER BY session) - 1 AS place FROM e), z AS (SELECT market, count(*) AS n FROM p WHERE arm = 'base' GROUP BY ALL),
b AS (SELECT market, n, CAST(r AS INTEGER) AS replicate, unnest(range((n - 1) // {BLOCK} + 1)) AS number FROM z, range({REPLICATES}) t(r)),
w AS (SELECT market, replicate, number * {BLOCK} + k AS i, (replicate * 7919 + number * 104729 + k) % n AS place FROM b, range({BLOCK}) u(k) WHERE number * {BLOCK} + k < n),
x AS (SELECT arm, market, replicate, e FROM p JOIN w USING (market, place))"""
DIFFERENCES = f"""{ERRORS}, m AS (SELECT replicate, arm, avg(e) AS e FROM x GROUP BY ALL), d AS (SELECT m.replicate, m.arm, m.e - o.e AS d FROM m JOIN m o ON o.replicate = m.replicate AND o.arm = 'base' WHERE m.arm <> 'base')"""
COALITIONS = f"""{PANEL_SQL}, s AS (SELECT unnest(['', 'level', 'scale', 'sign', 'level+scale', 'level+sign', 'scale+sign', 'level+scale+sign']) AS c),
q AS (SELECT c, market, session, target, prediction * CASE WHEN contains(c, 'scale') THEN 0.4::DOUBLE ELSE 1 END + CASE WHEN contains(c, 'level') THEN 0.004::DOUBLE ELSE 0 END AS p, contains(c, 'sign') AND l_linenumber % 2 = 0 AS f FROM panel, s),
g AS (SELECT c, market, session, avg(abs(target - CASE WHEN f THEN -p ELSE p END)) AS e FROM q GROUP BY ALL), worth AS (SELECT c, -avg(e) AS v FROM g GROUP BY ALL)"""
RETURNS = f"{DAILY}, r AS (SELECT user_id, day, (ln(1 + value) - lag(ln(1 + value)) OVER (PARTITION BY user_id ORDER BY day)) / 100 AS r FROM d QUALIFY r IS NOT NULL)"


def _path_sql(source: str, keys: str, order: str) -> str:
    return f"""c AS (SELECT *, sum(r) OVER w AS cum FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(max(cum) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING), 0) AS peak FROM c),
s AS (SELECT {keys}, count(*) AS n, sum(r) AS total, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) AS down, max(1 - exp(cum - peak)) AS max_drawdown FROM k GROUP BY ALL),
o AS (SELECT {keys}, n, exp(total) - 1 AS cumulative, exp(total * 252.0 / n) - 1 AS annual, sd * sqrt(252.0) AS volatility, CASE WHEN sd > 0 THEN mean / sd * sqrt(252.0) END AS sharpe, CASE WHEN down > 0 THEN mean / down * sqrt(252.0) END AS sortino, max_drawdown FROM s)"""


REGISTERED = {
    "stratified_bootstrap": (
        stratified_bootstrap,
        f"""
WITH {ERRORS}, m AS (SELECT replicate, market, avg(e) AS e, count(*) AS n FROM x WHERE arm = 'base' GROUP BY ALL)
SELECT replicate, round(sum(e * n) / sum(n), 9) AS mean, CAST(sum(n) AS BIGINT) AS sessions FROM m GROUP BY ALL""",
    ),
    "relative_draws": (
        relative_draws,
        f"""
WITH {ERRORS}, m AS (SELECT replicate, market, {', '.join(f"avg(e) FILTER (arm = '{a}') AS {a}" for a in ARMS)} FROM x GROUP BY ALL)
SELECT replicate, market, {', '.join(f"round(({a} - base) / base, 7) AS {a}" for a in ARMS if a != 'base')} FROM m""",
    ),
    "family_comparison": (
        family_comparison,
        f"""
WITH {DIFFERENCES}, v AS (SELECT arm, stddev_samp(d) AS sd FROM d GROUP BY ALL), a AS (SELECT arm, avg(e) AS e FROM p GROUP BY ALL),
t AS (SELECT a.arm, a.e - (SELECT e FROM a WHERE arm = 'base') AS estimate, sd, abs(a.e - (SELECT e FROM a WHERE arm = 'base')) / sd AS stat FROM a JOIN v USING (arm)),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY stat DESC, arm) AS INTEGER) AS rank FROM t),
y AS (SELECT replicate, k.arm, rank, stat, max(abs(d.d - estimate) / sd) OVER (PARTITION BY replicate ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS most FROM d JOIN k ON k.arm = d.arm),
q AS (SELECT arm, (1 + count(*) FILTER (most >= stat)) / (1 + count(*)) AS p FROM y GROUP BY ALL), h AS (SELECT quantile_cont(most, 0.9) AS h FROM y WHERE rank = 1)
SELECT k.arm, rank, round(estimate, 7) AS estimate, round(sd, 7) AS deviation, round(estimate - h * sd, 7) AS low, round(estimate + h * sd, 7) AS high, round(max(p) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 7) AS p_value FROM k JOIN q ON q.arm = k.arm, h""",
    ),
    "seed_decisions": (
        seed_decisions,
        f"""
WITH {DIFFERENCES}, i AS (SELECT arm, quantile_cont(d, 0.05) AS low, quantile_cont(d, 0.95) AS high, CASE WHEN arm = 'tenth' THEN 1 ELSE 0.00001 END AS band FROM d GROUP BY ALL)
SELECT arm, CASE WHEN high - low < band THEN 'not_interpretable' WHEN high < -0.003 THEN 'keep' WHEN low > 0 THEN 'abandon' ELSE 'undecided' END AS superiority,
  CASE WHEN high - low < band THEN 'not_interpretable' WHEN high < 0.003 THEN 'keep' WHEN low > 0.004 THEN 'abandon' ELSE 'undecided' END AS non_inferiority,
  CASE WHEN high - low < band THEN 'not_interpretable' WHEN low > -0.003 AND high < 0.003 THEN 'keep' WHEN low > 0.003 OR high < -0.003 THEN 'abandon' ELSE 'undecided' END AS equivalence FROM i""",
    ),
    "linear_contrasts": (
        linear_contrasts,
        f"""
WITH {ERRORS}, a AS (SELECT market, arm, avg(e) AS e FROM p GROUP BY ALL), v AS (SELECT market, {', '.join(f"max(e) FILTER (arm = '{a}') AS {a}" for a in ARMS)} FROM a GROUP BY ALL)
SELECT market, 'halving' AS contrast, round(half - base, 9) AS value FROM v UNION ALL SELECT market, 'curve', round(base - 2 * half + tenth, 9) FROM v UNION ALL SELECT market, 'broken', NULL FROM v""",
    ),
    "shapley": (
        shapley,
        f"""
WITH {COALITIONS}, w AS (SELECT x.c AS a, y.c AS b, y.v - x.v AS gain, len(string_split(x.c, '+')) * CAST(x.c <> '' AS INTEGER) AS k, n FROM worth x, worth y, (VALUES ('level'), ('scale'), ('sign')) t(n)
  WHERE contains(y.c, n) AND NOT contains(x.c, n) AND replace(replace(replace(y.c, n, ''), '++', '+'), '+', '') = replace(x.c, '+', ''))
SELECT n AS component, round(sum(gain * CASE k WHEN 1 THEN 1 / 6.0 ELSE 1 / 3.0 END), 9) AS value FROM w GROUP BY ALL""",
    ),
    "factorial_contrasts": (
        factorial_contrasts,
        f"""
WITH {COALITIONS}, z AS (SELECT v, CASE WHEN contains(c, 'level') THEN 1 ELSE -1 END AS a, CASE WHEN contains(c, 'scale') THEN 1 ELSE -1 END AS b, CASE WHEN contains(c, 'sign') THEN 1 ELSE -1 END AS g FROM worth),
f AS (SELECT sum(v * a) / 4 AS "level", sum(v * b) / 4 AS "scale", sum(v * g) / 4 AS "sign", sum(v * a * b) / 4 AS "level:scale", sum(v * a * g) / 4 AS "level:sign", sum(v * b * g) / 4 AS "scale:sign", sum(v * a * b * g) / 4 AS "level:scale:sign" FROM z)
SELECT effect, round(value, 9) AS value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME effect VALUE value)""",
    ),
    "portfolio_statistics": (
        portfolio_statistics,
        f"""
WITH {RETURNS}, {_path_sql('r', 'user_id', 'day')}
SELECT user_id, n, {', '.join(f'round({c}, 7) AS {c}' for c in ('cumulative', 'annual', 'volatility', 'sharpe', 'sortino', 'max_drawdown'))} FROM o""",
    ),
    "equity_metrics": (
        equity_metrics,
        f"""
WITH {DAILY}, t AS (SELECT *, abs(volume - coalesce(lag(volume) OVER (PARTITION BY user_id ORDER BY day), 0)) AS turnover FROM d),
n AS (SELECT *, 1000 + sum(value - 0.5 * turnover) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM t),
r AS (SELECT *, ln(nav / coalesce(lag(nav) OVER (PARTITION BY user_id ORDER BY day), 1000)) AS r FROM n), {_path_sql('r', 'user_id', 'day')},
f AS (SELECT user_id, CAST(sum(turnover) AS BIGINT) AS turnover, round(arg_max(nav, day), 6) AS final FROM n GROUP BY ALL)
SELECT o.user_id, n, turnover, final, round(cumulative, 7) AS cumulative, round(sharpe, 6) AS sharpe, round(max_drawdown, 7) AS max_drawdown FROM o JOIN f ON f.user_id = o.user_id""",
    ),
    "resampled_statistics": (
        resampled_statistics,
        f"""
WITH {RETURNS}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS length FROM r),
z AS (SELECT DISTINCT user_id, length FROM i), b AS (SELECT user_id, length, CAST(q AS INTEGER) AS replicate, unnest(range((length - 1) // 5 + 1)) AS number FROM z, range(4) t(q)),
w AS (SELECT user_id, replicate, number * 5 + j AS pos, (replicate * 31 + number * 17 + user_id + j) % length AS place FROM b, range(5) u(j) WHERE number * 5 + j < length),
x AS (SELECT user_id, replicate, pos, r FROM i JOIN w USING (user_id, place)), {_path_sql('x', 'user_id, replicate', 'pos')}
SELECT replicate, count(*) AS users, round(avg(cumulative), 7) AS cumulative, round(avg(sharpe), 6) AS sharpe, round(max(max_drawdown), 7) AS max_drawdown FROM o GROUP BY ALL""",
    ),
}
