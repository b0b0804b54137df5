"""Queries that score a panel in full: session scores, calls, matured labels, registries, variants against their originals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import scoring as S
from tidemark.plans.panel import KEYS, LEVELS, PANEL_SQL, WIDTHS, panel


def quantiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).withColumns({f"q{i}": F.col("prediction") + w for i, w in enumerate(WIDTHS)})


QUANTILED = f"""{PANEL_SQL}, q AS (SELECT *, prediction - 0.06 AS a, prediction - 0.03 AS b, prediction AS c, prediction + 0.03 AS d, prediction + 0.06 AS e, target AS y FROM panel)"""
UP = """CASE WHEN a >= 0 THEN 0.975 WHEN b >= 0 THEN 1 - (0.025 + 0.075 * (-a / (b - a))) WHEN c >= 0 THEN 1 - (0.1 + 0.4 * (-b / (c - b)))
    WHEN d >= 0 THEN 1 - (0.5 + 0.4 * (-c / (d - c))) WHEN e >= 0 THEN 1 - (0.9 + 0.075 * (-d / (e - d))) ELSE 0.025 END"""


def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of each (market, session)."""
    return S.session_scores(quantiled(spark, sf_dir), KEYS, "target", "prediction", list(LEVELS), [f"q{i}" for i in range(5)])


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up probability of each market in ten bins, against what happened."""
    up = C.implied_up_probability(list(LEVELS), [F.col(f"q{i}") for i in range(5)])
    outcome = F.when(S.sign(F.col("target")) != 0, S.sign(F.col("target")) > 0)
    return S.reliability_bins(quantiled(spark, sf_dir).withColumn("up", F.round(up, 7)), ["market"], F.col("up"), outcome)


def directional_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market: rows with a target that moves, with a call on them, and with the right one."""
    moves, calls = S.sign(F.col("target")) != 0, S.sign(F.col("prediction")) != 0
    right = calls & (S.sign(F.col("target")) == S.sign(F.col("prediction")))
    return panel(spark, sf_dir).groupBy("market").agg(
        F.count_if(moves).alias("eligible"), F.count_if(moves & calls).alias("called"), F.count_if(moves & right).alias("right"),
        F.round(F.avg(F.when(moves, calls.cast("double"))), 9).alias("call_coverage"), F.round(F.avg(F.when(moves & calls, right.cast("double"))), 9).alias("hit_rate"),
    )


def calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market the slope through the origin of target on prediction with session weights, NULL without spread."""
    w = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    x, y = F.col("prediction"), F.col("target")
    sums = panel(spark, sf_dir).withColumn("w", w).groupBy("market").agg(F.sum(F.col("w") * x * y).alias("xy"), F.sum(F.col("w") * x * x).alias("xx"))
    return sums.select("market", F.round(C.safe_ratio(F.col("xy"), F.col("xx")), 7).alias("slope"))


def matched_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many abstentions per session as a neutral band makes, on the rows of widest score instead: how both err on the rows they keep."""
    band = F.abs(F.round("prediction", 6)) <= 0.01
    rows = panel(spark, sf_dir).withColumn("band", band).withColumn("score", F.when(F.col("l_linenumber") != 3, F.round(F.abs("target"), 6)))
    rows = S.matched(rows, KEYS, F.col("band"), F.lit(True), "score", ["l_orderkey", "l_linenumber", "target", "prediction"], "matched")
    error = F.abs(F.col("target") - F.col("prediction"))
    return rows.groupBy("market").agg(
        F.count_if("band").alias("band_rows"), F.count_if("matched").alias("matched_rows"), F.round(F.avg(F.when(~F.col("band"), error)), 9).alias("band_kept"), F.round(F.avg(F.when(~F.col("matched"), error)), 9).alias("matched_kept")
    )


def _matured(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.timeline import daily

    return daily(spark, sf_dir).withColumn("matures", F.date_add("day", 3))


def past_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user-day's median of the last five values that had matured, NULL under three of them."""
    found = S.trailing_mature(_matured(spark, sf_dir), ["user_id"], "day", "matures", "value", 5, 3, "median", "past")
    return found.select("user_id", "day", F.round("past", 6).alias("past"))


def past_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user-day's root mean square of the last seven matured values."""
    found = S.trailing_mature(_matured(spark, sf_dir), ["user_id"], "day", "matures", "value", 7, 2, "rms", "past")
    return found.select("user_id", "day", F.round("past", 6).alias("past"))


def _past_sql(length: int, minimum: int, summary: str) -> str:
    return f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS value FROM events GROUP BY ALL),
m AS (SELECT a.user_id, a.day, b.value, row_number() OVER (PARTITION BY a.user_id, a.day ORDER BY b.day DESC) AS r
  FROM d a JOIN d b ON a.user_id = b.user_id AND b.day + 3 <= a.day),
s AS (SELECT user_id, day, count(*) AS n, {summary} AS s FROM m WHERE r <= {length} GROUP BY ALL)
SELECT d.user_id, d.day, CASE WHEN n >= {minimum} THEN round(s, 6) END AS past FROM d LEFT JOIN s ON d.user_id = s.user_id AND d.day = s.day"""


NAMES = ["mae", "rmse", "bias", "hit_rate", "pinball_50", "pinball_90", "within_40"]
METRIC_SQL = """avg(abs(target - prediction)) AS mae, sqrt(avg((target - prediction) * (target - prediction))) AS rmse, avg(prediction - target) AS bias,
  avg(CASE WHEN sign(round(target, 6)) * sign(round(prediction, 6)) <> 0 THEN CASE WHEN sign(round(target, 6)) = sign(round(prediction, 6)) THEN 1.0 ELSE 0.0 END END) AS hit_rate,
  avg(greatest(0.5 * (target - prediction), -0.5 * (target - prediction))) AS pinball_50, avg(greatest(0.9 * (target - prediction), (0.9 - 1) * (target - prediction))) AS pinball_90,
  avg(CASE WHEN round(abs(target - prediction), 9) <= 0.04 THEN 1.0 ELSE 0.0 END) AS within_40"""


def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared metrics of each market by name, computed again from the rows."""
    return S.reconstructed(panel(spark, sf_dir), ["market"], NAMES, "target", "prediction", 7)


def summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published summary, one market's errors falsified, one metric undeclared and one missing, against the registry."""
    expected = S.reconstructed(panel(spark, sf_dir), ["market"], NAMES, "target", "prediction", 7)
    published = expected.where("metric <> 'bias'").withColumn("value", F.col("value") + F.when((F.col("market") == "N") & (F.col("metric") == "mae"), 0.001).otherwise(0.0))
    published = published.unionByName(expected.where("metric = 'mae'").withColumn("metric", F.lit("median_error")))
    return S.check_summary(published, expected, ["market"], 1e-6)


def zero_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel against the same rows predicted as zero: session-weighted errors and the skill over them."""
    p = panel(spark, sf_dir)
    both = p.withColumn("zero", F.lit(0.0)).groupBy(*KEYS).agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e"), F.avg(F.abs(F.col("target") - F.col("zero"))).alias("z"))
    return both.groupBy("market").agg(F.round(F.avg("e"), 9).alias("mae"), F.round(F.avg("z"), 9).alias("zero_mae"), F.round(1 - F.avg("e") / F.avg("z"), 7).alias("skill"))


def variance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within 1.96 predicted standard deviations by session, the variance that of the market's session before; then per market."""
    s = panel(spark, sf_dir).groupBy(*KEYS).agg(F.var_pop(F.col("target") - F.col("prediction")).alias("v"))
    s = s.withColumn("v", F.lag("v").over(Window.partitionBy("market", F.year("session")).orderBy("session")))
    j = panel(spark, sf_dir).join(s, KEYS).where("v is not null")
    inside = F.round(F.abs(F.col("target") - F.col("prediction")) - 1.96 * F.sqrt("v"), 9) <= 0
    by = j.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("k"))
    return by.groupBy("market").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("rows"), F.sum("k").alias("inside"), F.round(F.avg(F.col("k") / F.col("n")), 9).alias("coverage"))


def ablation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the prediction against the original on the rows they affect: session-weighted errors of both and their difference."""
    p = panel(spark, sf_dir)
    variants = {"shrunk": (F.col("l_linenumber") <= 2, F.col("prediction") * 0.5), "silenced": (F.col("l_orderkey") % 5 == 0, F.lit(0.0)), "shifted": (F.lit(True), F.col("prediction") + 0.01)}
    rows = p.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), when.alias("affected"), value.alias("other")) for n, (when, value) in variants.items()])).alias("v")).select(*p.columns, "v.*").where("affected")
    s = rows.groupBy("variant", *KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("a"), F.avg(F.abs(F.col("target") - F.col("other"))).alias("b"))
    return s.groupBy("variant", "market").agg(F.sum("n").alias("rows"), F.round(F.avg("a"), 9).alias("original"), F.round(F.avg("b"), 9).alias("masked"), F.round(F.avg(F.col("b") - F.col("a")), 9).alias("difference"))


def drift_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of prediction change and error difference by days since the market's last burst session, which add up over windows."""
    p = panel(spark, sf_dir)
    s = p.select(*KEYS).distinct().withColumn("burst", F.dayofyear("session") % 29 == 0)
    seen = F.last(F.when(F.col("burst"), F.col("session")), ignorenulls=True).over(Window.partitionBy("market").orderBy("session").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("since", F.datediff("session", seen))
    rows = p.join(s, KEYS).withColumn("other", F.col("prediction") + F.when(F.col("since") <= 7, 0.002 * (8 - F.col("since"))).otherwise(0.0))
    label = F.when(F.col("burst"), "inside").when(F.col("since") <= 3, "1-3").when(F.col("since") <= 10, "4-10").otherwise("far")
    change = F.abs(F.col("target") - F.col("other")) - F.abs(F.col("target") - F.col("prediction"))
    return rows.groupBy("market", label.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.abs(F.col("other") - F.col("prediction"))), 5).alias("moved"), F.round(F.sum(change), 5).alias("error_change"))


def difference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference in differences: control minus treated session errors before a cut, after it, and around a placebo cut."""
    s = panel(spark, sf_dir).withColumn("arm", F.when(F.col("l_orderkey") % 2 == 0, "treated").otherwise("control"))
    s = s.groupBy("market", "session", "arm").agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e"))
    s = s.groupBy("market", "session").agg(*[F.max(F.when(F.col("arm") == a, F.col("e"))).alias(a) for a in ("treated", "control")]).where("treated is not null and control is not null").withColumn("d", F.col("control") - F.col("treated"))
    block = lambda cut: F.when(F.col("session") < F.lit(cut).cast("date"), "pre").otherwise("post")
    s = s.select("market", "d", F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), block(c).alias("block")) for n, c in (("real", "1998-06-01"), ("placebo", "1996-06-01"))])).alias("c")).select("market", "d", "c.*")
    t = s.groupBy("market", "cut").agg(*[F.avg(F.when(F.col("block") == b, F.col("d"))).alias(b) for b in ("pre", "post")], F.count(F.lit(1)).alias("sessions"))
    return t.select("market", "cut", "sessions", F.round("pre", 8).alias("pre"), F.round("post", 8).alias("post"), F.round(F.col("post") - F.col("pre"), 8).alias("effect"))


def campaign_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds averaged by session, sessions by window (year) and market, windows with equal weight: each model against the first."""
    rows = panel(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed")).select("*", F.explode(F.array(F.lit("base"), F.lit("half"), F.lit("zero"))).alias("model"))
    factor = F.when(F.col("model") == "base", 1.0).when(F.col("model") == "half", 0.5).otherwise(0.0) * (1 + 0.05 * F.col("seed"))
    s = rows.groupBy("model", "seed", *KEYS).agg(F.avg(F.abs(F.col("target") - F.col("prediction") * factor)).alias("e"))
    s = s.groupBy("model", *KEYS).agg(F.avg("e").alias("e"), F.count(F.lit(1)).alias("seeds")).where("seeds = 3")
    w = s.groupBy("model", "market", F.year("session").alias("window")).agg(F.avg("e").alias("e"))
    m = w.groupBy("model", "window").agg(F.avg("e").alias("e")).groupBy("model").agg(F.count(F.lit(1)).alias("windows"), F.avg("e").alias("e"))
    base = m.where("model = 'base'").select(F.col("e").alias("b"))  # one row
    return m.crossJoin(F.broadcast(base)).select("model", "windows", F.round("e", 9).alias("mae"), F.round(F.col("e") / F.col("b") - 1, 7).alias("relative"))


def campaign_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius at 90 percent from each model's calibration years, its coverage and sign calls in the others."""
    rows = panel(spark, sf_dir).select("market", F.year("session").alias("y"), "target", F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("prediction").alias("p")), F.struct(F.lit("half").alias("model"), (F.col("prediction") * 0.5).alias("p")))).alias("m")).select("market", "y", "target", "m.*")
    rows = rows.withColumn("error", F.round(F.abs(F.col("target") - F.col("p")), 9))
    # errors take few values after rounding: counts by value, so that no market's rows meet in one task
    counts = rows.where("y < 1997").groupBy("model", "market", "error").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("model", "market")
    counts = counts.withColumn("below", F.sum("c").over(w.orderBy("error").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    radius = counts.where(F.col("below") >= C.ceil_percent(F.col("n") + 1, 90)).groupBy("model", "market", "n").agg(F.min("error").alias("radius"))
    j = rows.where("y >= 1997").join(F.broadcast(radius), ["model", "market"])  # a row for each model and market
    excludes = F.round(F.abs("p") - F.col("radius"), 9) > 0
    return j.groupBy("model", "market").agg(F.first("n").alias("calibrated"), F.first("radius").alias("radius"), F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col("error") <= F.col("radius")).cast("double")), 9).alias("coverage"), F.count_if(excludes).alias("calls"))


def lesion_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session errors with growing fractions of the rows' predictions silenced, the same rows at every fraction and more."""
    rows = panel(spark, sf_dir).withColumn("u", F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101, F.lit(100)))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, (0, 25, 50, 75, 100)))).alias("percent"))
    s = rows.groupBy("percent", *KEYS).agg(F.avg(F.abs(F.col("target") - F.when(F.col("u") < F.col("percent"), 0.0).otherwise(F.col("prediction")))).alias("e"))
    return s.groupBy("percent", "market").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("e"), 9).alias("mae"))


REGISTERED = {
    "session_scores": (
        session_scores,
        f"""
WITH {QUANTILED}, r AS (SELECT *, count(*) OVER (PARTITION BY market, session) AS k, sign(round(target, 6)) AS sy, sign(round(prediction, 6)) AS sp, {UP} AS up,
  rank() OVER (PARTITION BY market, session ORDER BY target) + (count(*) OVER (PARTITION BY market, session, target) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY market, session ORDER BY prediction) + (count(*) OVER (PARTITION BY market, session, prediction) - 1) / 2.0 AS rx FROM q),
s AS (SELECT market, session, count(*) AS n, round(avg(abs(y - c)), 9) AS mae, round(avg((y - c) * (y - c)), 9) AS mse, count(*) FILTER (sy * sp > 0) AS hits, count(*) FILTER (sy * sp < 0) AS misses,
  count(*) FILTER (sy * sp = 0) AS zeros, count(*) FILTER (sy > 0 AND sp > 0) AS up_hits, count(*) FILTER (sy < 0 AND sp < 0) AS down_hits,
  round(avg(greatest(0.025 * (y - a), (0.025 - 1) * (y - a))), 9) AS pinball_0, round(avg(greatest(0.1 * (y - b), (0.1 - 1) * (y - b))), 9) AS pinball_1,
  round(avg(greatest(0.5 * (y - c), (0.5 - 1) * (y - c))), 9) AS pinball_2, round(avg(greatest(0.9 * (y - d), (0.9 - 1) * (y - d))), 9) AS pinball_3, round(avg(greatest(0.975 * (y - e), (0.975 - 1) * (y - e))), 9) AS pinball_4,
  round(avg(CASE WHEN round(y - a, 9) >= 0 AND round(e - y, 9) >= 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage_0, round(avg(CASE WHEN round(y - b, 9) >= 0 AND round(d - y, 9) >= 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage_1,
  round(avg(e - a), 9) AS width_0, round(avg(d - b), 9) AS width_1,
  round(avg(e - a + CASE WHEN y < a THEN 40 * (a - y) WHEN y > e THEN 40 * (y - e) ELSE 0 END), 9) AS interval_0, round(avg(d - b + CASE WHEN y < b THEN 10 * (b - y) WHEN y > d THEN 10 * (y - d) ELSE 0 END), 9) AS interval_1,
  round(avg(CASE WHEN sy <> 0 THEN pow(up - CASE WHEN sy > 0 THEN 1 ELSE 0 END, 2) END), 7) AS brier,
  sum((rx - (k + 1) / 2.0) * (rx - (k + 1) / 2.0)) AS xx, sum((ry - (k + 1) / 2.0) * (ry - (k + 1) / 2.0)) AS yy, sum((rx - (k + 1) / 2.0) * (ry - (k + 1) / 2.0)) AS xy FROM r GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 3 THEN 'too_few' WHEN xx < 1e-9 AND yy < 1e-9 THEN 'both_constant' WHEN xx < 1e-9 THEN 'x_constant' WHEN yy < 1e-9 THEN 'y_constant' ELSE 'defined' END AS status FROM s)
SELECT * EXCLUDE (xx, yy, xy), CASE WHEN status = 'defined' THEN round(xy / sqrt(xx * yy), 9) END AS rank_ic FROM t""",
    ),
    "reliability_bins": (
        reliability_bins,
        f"""
WITH {QUANTILED}, u AS (SELECT market, round({UP}, 7) AS p, CASE WHEN round(y, 6) > 0 THEN 1.0 WHEN round(y, 6) < 0 THEN 0.0 END AS o FROM q)
SELECT market, CAST(least(floor(round(p * 10, 9)), 9) AS INTEGER) AS bin, count(*) AS n, round(sum(p), 7) AS probability, CAST(sum(o) AS DOUBLE) AS outcomes FROM u WHERE o IS NOT NULL GROUP BY ALL""",
    ),
    "directional_calls": (
        directional_calls,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, sign(round(target, 6)) AS y, sign(round(prediction, 6)) AS p FROM panel)
SELECT market, count(*) FILTER (y <> 0) AS eligible, count(*) FILTER (y <> 0 AND p <> 0) AS called, count(*) FILTER (y <> 0 AND y = p) AS "right",
  round(avg(CASE WHEN p <> 0 THEN 1.0 ELSE 0.0 END) FILTER (y <> 0), 9) AS call_coverage, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FILTER (y <> 0 AND p <> 0), 9) AS hit_rate FROM s GROUP BY ALL""",
    ),
    "calibration_slope": (
        calibration_slope,
        f"""
WITH {PANEL_SQL}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY market, session) AS w FROM panel)
SELECT market, CASE WHEN sum(w * prediction * prediction) <> 0 THEN round(sum(w * prediction * target) / sum(w * prediction * prediction), 7) END AS slope FROM w GROUP BY ALL""",
    ),
    "matched_abstention": (
        matched_abstention,
        f"""
WITH {PANEL_SQL}, b AS (SELECT *, abs(round(prediction, 6)) <= 0.01 AS band, CASE WHEN l_linenumber <> 3 THEN round(abs(target), 6) END AS score FROM panel),
m AS (SELECT *, row_number() OVER (PARTITION BY market, session ORDER BY score DESC NULLS LAST, l_orderkey, l_linenumber, target, prediction) <= count(*) FILTER (band) OVER (PARTITION BY market, session) AS matched FROM b)
SELECT market, count(*) FILTER (band) AS band_rows, count(*) FILTER (matched) AS matched_rows, round(avg(abs(target - prediction)) FILTER (NOT band), 9) AS band_kept, round(avg(abs(target - prediction)) FILTER (NOT matched), 9) AS matched_kept FROM m GROUP BY ALL""",
    ),
    "past_median": (past_median, _past_sql(5, 3, "median(value)")),
    "past_volatility": (past_volatility, _past_sql(7, 2, "sqrt(avg(value * value))")),
    "metric_registry": (
        metric_registry,
        f"""
WITH {PANEL_SQL}, m AS (SELECT market, {METRIC_SQL} FROM panel GROUP BY ALL)
SELECT market, metric, round(value, 7) AS value FROM (UNPIVOT (SELECT market, mae::DOUBLE AS mae, rmse::DOUBLE AS rmse, bias::DOUBLE AS bias, hit_rate::DOUBLE AS hit_rate, pinball_50::DOUBLE AS pinball_50, pinball_90::DOUBLE AS pinball_90, within_40::DOUBLE AS within_40 FROM m) ON mae, rmse, bias, hit_rate, pinball_50, pinball_90, within_40 INTO NAME metric VALUE value)""",
    ),
    "summary_check": (
        summary_check,
        """
WITH n AS (SELECT unnest(['mae', 'rmse', 'hit_rate', 'pinball_50', 'pinball_90', 'within_40', 'bias', 'median_error']) AS metric), k AS (SELECT DISTINCT l_returnflag AS market FROM lineitem)
SELECT metric, CASE WHEN metric = 'bias' THEN 'unpublished' WHEN metric = 'median_error' THEN 'undeclared' WHEN metric = 'mae' AND market = 'N' THEN 'differs' ELSE 'agrees' END AS state, count(*) AS "values" FROM n, k GROUP BY ALL""",
    ),
    "zero_benchmark": (
        zero_benchmark,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(abs(target - prediction)) AS e, avg(abs(target)) AS z FROM panel GROUP BY ALL)
SELECT market, round(avg(e), 9) AS mae, round(avg(z), 9) AS zero_mae, round(1 - avg(e) / avg(z), 7) AS skill FROM s GROUP BY ALL""",
    ),
    "variance_coverage": (
        variance_coverage,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, var_pop(target - prediction) AS v FROM panel GROUP BY ALL),
l AS (SELECT market, session, lag(v) OVER (PARTITION BY market, year(session) ORDER BY session) AS v FROM s),
b AS (SELECT market, session, count(*) AS n, count(*) FILTER (round(abs(target - prediction) - 1.96 * sqrt(v), 9) <= 0) AS k FROM panel JOIN l USING (market, session) WHERE v IS NOT NULL GROUP BY ALL)
SELECT market, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(k) AS BIGINT) AS inside, round(avg(k / n), 9) AS coverage FROM b GROUP BY ALL""",
    ),
    "ablation_pairs": (
        ablation_pairs,
        f"""
WITH {PANEL_SQL}, v AS (SELECT *, 'shrunk' AS variant, prediction * 0.5 AS other FROM panel WHERE l_linenumber <= 2 UNION ALL SELECT *, 'silenced', 0 FROM panel WHERE l_orderkey % 5 = 0 UNION ALL SELECT *, 'shifted', prediction + 0.01 FROM panel),
s AS (SELECT variant, market, session, count(*) AS n, avg(abs(target - prediction)) AS a, avg(abs(target - other)) AS b FROM v GROUP BY ALL)
SELECT variant, market, CAST(sum(n) AS BIGINT) AS rows, round(avg(a), 9) AS original, round(avg(b), 9) AS masked, round(avg(b - a), 9) AS difference FROM s GROUP BY ALL""",
    ),
    "drift_bins": (
        drift_bins,
        f"""
WITH {PANEL_SQL}, s AS (SELECT DISTINCT market, session, dayofyear(session) % 29 = 0 AS burst FROM panel),
l AS (SELECT *, session - max(CASE WHEN burst THEN session END) OVER (PARTITION BY market ORDER BY session) AS since FROM s),
r AS (SELECT p.*, burst, since, prediction + CASE WHEN since <= 7 THEN 0.002 * (8 - since) ELSE 0 END AS other FROM panel p JOIN l USING (market, session))
SELECT market, CASE WHEN burst THEN 'inside' WHEN since <= 3 THEN '1-3' WHEN since <= 10 THEN '4-10' ELSE 'far' END AS bin, count(*) AS rows, round(sum(abs(other - prediction)), 5) AS moved,
  round(sum(abs(target - other) - abs(target - prediction)), 5) AS error_change FROM r GROUP BY ALL""",
    ),
    "difference_blocks": (
        difference_blocks,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(abs(target - prediction)) FILTER (l_orderkey % 2 = 1) - avg(abs(target - prediction)) FILTER (l_orderkey % 2 = 0) AS d FROM panel GROUP BY ALL),
c AS (SELECT market, cut, d, session < cutday AS pre FROM s, (VALUES ('real', DATE '1998-06-01'), ('placebo', DATE '1996-06-01')) v(cut, cutday) WHERE d IS NOT NULL)
SELECT market, cut, count(*) AS sessions, round(avg(d) FILTER (pre), 8) AS pre, round(avg(d) FILTER (NOT pre), 8) AS post, round(avg(d) FILTER (NOT pre) - avg(d) FILTER (pre), 8) AS effect FROM c GROUP BY ALL""",
    ),
    "campaign_aggregate": (
        campaign_aggregate,
        f"""
WITH {PANEL_SQL}, e AS (SELECT model, seed, market, session, avg(abs(target - prediction * (f * (1 + 0.05::DOUBLE * seed)))) AS e FROM panel, (VALUES ('base', 1.0::DOUBLE), ('half', 0.5), ('zero', 0.0)) v(model, f), range(3) t(seed) GROUP BY ALL),
s AS (SELECT model, market, session, avg(e) AS e FROM e GROUP BY ALL), w AS (SELECT model, market, year(session) AS y, avg(e) AS e FROM s GROUP BY ALL),
k AS (SELECT model, y, avg(e) AS e FROM w GROUP BY ALL), m AS (SELECT model, count(*) AS windows, avg(e) AS e FROM k GROUP BY ALL)
SELECT model, windows, round(e, 9) AS mae, round(e / (SELECT e FROM m WHERE model = 'base') - 1, 7) AS relative FROM m""",
    ),
    "campaign_reliability": (
        campaign_reliability,
        f"""
WITH {PANEL_SQL}, r AS (SELECT market, model, year(session) AS y, prediction * f AS p, round(abs(target - prediction * f), 9) AS error FROM panel, (VALUES ('base', 1.0::DOUBLE), ('half', 0.5)) v(model, f)),
o AS (SELECT model, market, error, row_number() OVER (PARTITION BY model, market ORDER BY error) AS i, count(*) OVER (PARTITION BY model, market) AS n FROM r WHERE y < 1997),
q AS (SELECT model, market, n, error AS radius FROM o WHERE i = ((n + 1) * 90 + 99) // 100)
SELECT model, market, n AS calibrated, radius, count(*) AS rows, round(avg(CASE WHEN error <= radius THEN 1.0 ELSE 0.0 END), 9) AS coverage, count(*) FILTER (round(abs(p) - radius, 9) > 0) AS calls FROM r JOIN q USING (model, market) WHERE y >= 1997 GROUP BY ALL""",
    ),
    "lesion_curves": (
        lesion_curves,
        f"""
WITH {PANEL_SQL}, s AS (SELECT percent, market, session, avg(abs(target - CASE WHEN (l_orderkey * 37 + l_linenumber * 101) % 100 < percent THEN 0 ELSE prediction END)) AS e FROM panel, (VALUES (0), (25), (50), (75), (100)) v(percent) GROUP BY ALL)
SELECT percent, market, count(*) AS sessions, round(avg(e), 9) AS mae FROM s GROUP BY ALL""",
    ),
}
