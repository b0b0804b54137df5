"""Queries that retrieve, calibrate and replay: vectors, formulas, regressions, sequential machines, multiple testing."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.functions import formulas
from tidemark.operators import sequential as S
from tidemark.operators import vectors as V
from tidemark.plans.panel import KEYS, PANEL_SQL, panel
from tidemark.session import table


#: Rows that a moving average with a decay of a tenth remembers.
MEMORY = 400


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rows of the largest inner product with every 50th vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.nearest(e, e.where("vec_id % 50 = 0"), 3, "vec_id", "embedding").select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def kernel_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax-weighted mean label of all other vectors for every 50th."""
    e = table(spark, sf_dir, "embeddings")
    return V.kernel_regression(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 0.25).select(F.col("query_id").alias("vec_id"), F.round("estimate", 6).alias("estimate"))


def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", "place", F.round("mean", 7).alias("mean"))


def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.squared_medoid(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors, each the farthest from those before it."""
    e = table(spark, sf_dir, "embeddings")
    return spark.createDataFrame(list(enumerate(V.farthest_first(e, 0, 5, "vec_id", "embedding"))), "place int, vec_id long")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("volume"))


DAYS = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value, count(*) AS volume FROM events GROUP BY ALL)"


def formula_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived indicators with coded reasons, from formula text."""
    rules = {"growth": "value / value[p-1] - 1", "smooth": "mean(value[p-4:p-0])", "excess": "(value - smooth) ^ 2 / volume", "odd": "growth / (volume - volume)"}
    found = formulas.derive(_days(spark, sf_dir), rules, ["event_type"], "day")
    return found.select("event_type", "day", *[F.round(n, 7).alias(n) for n in rules], *[f"{n}_reason" for n in rules])


def vintage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of (user, type) values: valid from one version to the next; at five cuts the versions that hold."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("known")).agg(F.max_by("value", "event_id").alias("value"))
    e = e.withColumn("until", F.lead("known").over(Window.partitionBy("user_id", "event_type").orderBy("known")))
    cuts = F.explode(F.array(*[F.lit(f"2024-01-{d:02d}").cast("date") for d in (5, 10, 15, 20, 25)]))
    held = e.withColumn("cut", cuts).where((F.col("known") <= F.col("cut")) & (F.col("until").isNull() | (F.col("until") > F.col("cut"))))
    return held.groupBy("cut", "event_type").agg(F.count(F.lit(1)).alias("versions"), F.round(F.sum("value"), 5).alias("total"), F.max("known").alias("newest"))


def online_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections per type, one day at a time: the emission of a day matures on the next."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine, out, before = S.OnlineConformal(0.5, 0.9), [], None
        for r in rows.itertuples(index=False):
            if before is not None:
                machine.mature([before])
            used = machine.emit(2.0)
            before = abs(r.value - 50.0)
            out.append((r.event_type, r.day, round(used, 6)))
        return pd.DataFrame(out, columns=["event_type", "day", "radius"])

    return S.per_key(_days(spark, sf_dir), ["event_type"], ["day"], run, "event_type string, day date, radius double")


def cusum_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate per type and day from the mean squared deviation of values."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg(F.pow(F.col("value") - 50, 2)), 6).alias("square"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine = S.Gate(0.1, 3.0, 0.9)
        out = [(r.event_type, r.day, *(round(x, 6) for x in machine.update(r.square))) for r in rows.itertuples(index=False)]
        return pd.DataFrame(out, columns=["event_type", "day", "gate", "cusum"])

    return S.per_key(e, ["event_type"], ["day"], run, "event_type string, day date, gate double, cusum double")


def reliability_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages of a daily signal at two decay rates, folded over each type's ordered days."""
    d = _days(spark, sf_dir).withColumn("up", (F.col("value") > 50).cast("double"))
    w = Window.partitionBy("event_type").orderBy("day")
    # beyond MEMORY rows a value weighs less than a double's last digit, so that the frame is bounded
    start = F.when(F.row_number().over(w) <= MEMORY, 0.5).otherwise(0.0)
    fold = lambda rate: F.aggregate(F.collect_list("up").over(w.rowsBetween(-(MEMORY - 1), 0)), start, lambda a, x: a * (1 - rate) + x * rate)
    return d.select("event_type", "day", F.round(fold(0.1), 9).alias("slow"), F.round(fold(0.5), 9).alias("fast"))


def hmm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered probability of the high state and of a change, per type and day."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = S.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[46.0], [54.0]]), np.array([[6.0], [6.0]]))
        out = []
        for r in rows.itertuples(index=False):
            state, change = m.update(np.array([r.value]))
            out.append((r.event_type, r.day, round(float(state[1]), 7), round(change, 7)))
        return pd.DataFrame(out, columns=["event_type", "day", "high", "change"])

    return S.per_key(_days(spark, sf_dir), ["event_type"], ["day"], run, "event_type string, day date, high double, change double")


def mature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights over three constant forecasts, each day from the losses of the days before."""
    experts = np.array([42.0, 50.0, 58.0])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m, out = S.Mixture(3), []
        for r in rows.itertuples(index=False):
            w = m.weights()
            out.append((r.event_type, r.day, *(round(float(x), 7) for x in w)))
            m.update(w, np.minimum(np.abs(experts - r.value) / 10, 1))
        return pd.DataFrame(out, columns=["event_type", "day", "w0", "w1", "w2"])

    return S.per_key(_days(spark, sf_dir), ["event_type"], ["day"], run, "event_type string, day date, w0 double, w1 double, w2 double")


def portfolio_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio per user over days: events' values are opens and closes, the type is the asset, orders follow the last close."""
    e = table(spark, sf_dir, "events").where("value > 0.5").groupBy("user_id", F.col("ts").cast("date").alias("day"), "event_type").agg(F.min_by("value", "event_id").alias("open"), F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        book, out = S.Portfolio(1000.0), []
        for (user, day), part in groupby(rows.itertuples(index=False), key=lambda r: (r.user_id, r.day)):  # rows come in order of days
            some = list(part)
            opens, closes = {r.event_type: r.open for r in some}, {r.event_type: r.close for r in some}
            r = book.session(opens, closes, {r.event_type: 20 * int(r.n) for r in some})
            book.orders = {a: 10 if c < 50 else 0 for a, c in closes.items()}
            out.append((int(user), day, round(r["value"], 6), round(r["traded"], 6), round(r["taxes"], 6), int(r["unfilled"])))
        return pd.DataFrame(out, columns=["user_id", "day", "value", "traded", "taxes", "unfilled"])

    return S.per_key(e, ["user_id"], ["day", "event_type"], run, "user_id long, day date, value double, traded double, taxes double, unfilled int")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a board publishes for a series of scores, per type."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        board = S.Leaderboard(0.25)
        return pd.DataFrame([(r.event_type, r.day, round(board.submit(r.value), 6)) for r in rows.itertuples(index=False)], columns=["event_type", "day", "published"])

    return S.per_key(_days(spark, sf_dir), ["event_type"], ["day"], run, "event_type string, day date, published double")


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge of the price on quantity and discount per market for two penalties, from sufficient statistics alone."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("market"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = {c: F.avg(c) for c in "aby"}
    s = li.groupBy("market").agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"m{c}") for c, v in m.items()], *[F.sum(F.col(x) * F.col(z)).alias(f"{x}{z}") for x, z in ("aa", "bb", "ab", "ay", "by")])
    centred = {f"{x}{z}": F.col(f"{x}{z}") - F.col("n") * F.col(f"m{x}") * F.col(f"m{z}") for x, z in ("aa", "bb", "ab", "ay", "by")}
    s = s.select("market", "n", "ma", "mb", "my", *[v.alias(f"s{k}") for k, v in centred.items()], F.explode(F.array(F.lit(1.0), F.lit(1000.0))).alias("penalty"))
    aa, bb, ab = F.col("saa") + F.col("penalty"), F.col("sbb") + F.col("penalty"), F.col("sab")
    d = aa * bb - ab * ab
    u, v = (bb * F.col("say") - ab * F.col("sby")) / d, (aa * F.col("sby") - ab * F.col("say")) / d
    return s.select("market", "penalty", F.round(u, 6).alias("quantity"), F.round(v, 6).alias("discount"), F.round(F.col("my") - u * F.col("ma") - v * F.col("mb"), 5).alias("intercept"))


def holm_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjusted p-values within each nation; p follows from a customer's key."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", ((F.col("c_custkey") * 37 % 101 + 1) / 2000.0).alias("p"))
    w = Window.partitionBy("c_nationkey")
    ranked = c.withColumn("step", (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("p", "c_custkey")) + 1) * F.col("p"))
    return ranked.select("c_nationkey", "c_custkey", F.round(F.least(F.max("step").over(w.orderBy("p", "c_custkey").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)), 9).alias("adjusted"))


def sharpe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, skewness and full kurtosis of the sessions' mean errors per market."""
    s = panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.col("target") - F.col("prediction")).alias("r"))
    return s.groupBy("market").agg(F.round(F.avg("r"), 9).alias("mean"), F.round(F.stddev_samp("r"), 9).alias("deviation"), F.round(F.skewness("r"), 6).alias("skewness"), F.round(F.kurtosis("r") + 3, 6).alias("kurtosis"), F.round(F.avg("r") / F.stddev_samp("r"), 7).alias("ratio"))


def net_returns_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net daily return of a market's book at three costs of trading."""
    day = panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.signum(F.round("prediction", 6)) * F.col("target")).alias("gross"), F.avg(F.abs("prediction")).alias("traded"))
    costs = F.explode(F.array(F.lit(0), F.lit(5), F.lit(20)))
    return day.withColumn("bps", costs).groupBy("market", "bps").agg(F.round(F.avg(F.col("gross") - F.col("bps") / 1e4 * F.col("traded")), 9).alias("net"), F.count_if(F.col("gross") - F.col("bps") / 1e4 * F.col("traded") > 1e-9).alias("days_up"))


def estimability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of market and quantity stratum, reported only with enough rows and sessions."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("market"), F.floor((F.col("l_quantity") - 1) / 10).alias("stratum"), F.col("l_shipdate").cast("date").alias("session"), "l_tax")
    c = li.groupBy("market", "stratum").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("sessions"), F.avg("l_tax").alias("m"))
    return c.select("market", "stratum", "rows", "sessions", F.when((F.col("rows") >= 500) & (F.col("sessions") >= 300), F.round("m", 9)).alias("tax"))


def fuzzy_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the weights that parts put on five neighbouring price buckets, by brand."""
    p = table(spark, sf_dir, "part")
    x = p.withColumn("u", (F.col("p_size") - 1) / 49.0)
    return x.select("p_brand", F.posexplode(C.fuzzy_buckets(F.col("u"), 5)).alias("bucket", "w")).groupBy("p_brand", "bucket").agg(F.round(F.sum("w"), 6).alias("weight"))


def hash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed feature hashing of the passages' words into sixteen places."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(C.tokens(F.lower("text"))).alias("w"))
    h = F.conv(F.substring(F.sha2(F.col("w").cast("binary"), 256), 1, 7), 16, 10).cast("long")
    return t.select("item_id", F.pmod(h, F.lit(16)).alias("place"), F.when(F.pmod(F.floor(h / 16), F.lit(2)) == 0, 1).otherwise(-1).alias("s")).groupBy("item_id", "place").agg(F.sum("s").alias("value"))


def masked_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the daily values of each two event types over users' common days; zero for too few."""
    d = table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    a, b = d.selectExpr("event_type AS x", "user_id", "day", "v AS vx"), d.selectExpr("event_type AS y", "user_id", "day", "v AS vy")
    j = a.join(b, ["user_id", "day"]).where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("vx").alias("sx"), F.sum("vy").alias("sy"), F.sum(F.col("vx") * F.col("vx")).alias("xx"), F.sum(F.col("vy") * F.col("vy")).alias("yy"), F.sum(F.col("vx") * F.col("vy")).alias("xy"))
    top, bottom = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt((F.col("xx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")))
    return j.select("x", "y", "n", F.when(F.col("n") < 30, 0.0).otherwise(F.round(top / bottom, 6)).alias("correlation"))


REGISTERED = {
    "knn_topk": (
        knn_topk,
        """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS s FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 3""",
    ),
    "kernel_regression": (
        kernel_regression,
        """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id, c.label, exp(list_inner_product(q.v, c.v) / 0.25) AS w FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT vec_id, round(sum(w * label) / sum(w), 6) AS estimate FROM p GROUP BY ALL""",
    ),
    "mean_vectors": (
        mean_vectors,
        """
WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings)
SELECT label, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 7) AS mean FROM u GROUP BY ALL""",
    ),
    "medoids": (
        medoids,
        """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT a.label, a.vec_id, sum(pow(list_distance(a.v, b.v), 2)) AS cost FROM e a JOIN e b ON a.label = b.label GROUP BY ALL)
SELECT label, arg_min(vec_id, {'c': round(cost, 5), 'i': vec_id}) AS vec_id FROM c GROUP BY ALL""",
    ),
    "farthest_first": (
        farthest_first,
        """
WITH c0 AS (SELECT vec_id, embedding AS c FROM embeddings WHERE vec_id = 0),
d0 AS (SELECT vec_id, embedding, list_sum(list_transform(list_zip(embedding, (SELECT c FROM c0)), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS d FROM embeddings),
c1 AS (SELECT vec_id, embedding AS c FROM d0 ORDER BY d DESC, vec_id LIMIT 1),
d1 AS (SELECT vec_id, embedding, least(d, list_sum(list_transform(list_zip(embedding, (SELECT c FROM c1)), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d FROM d0),
c2 AS (SELECT vec_id, embedding AS c FROM d1 ORDER BY d DESC, vec_id LIMIT 1),
d2 AS (SELECT vec_id, embedding, least(d, list_sum(list_transform(list_zip(embedding, (SELECT c FROM c2)), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d FROM d1),
c3 AS (SELECT vec_id, embedding AS c FROM d2 ORDER BY d DESC, vec_id LIMIT 1),
d3 AS (SELECT vec_id, embedding, least(d, list_sum(list_transform(list_zip(embedding, (SELECT c FROM c3)), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d FROM d2),
c4 AS (SELECT vec_id, embedding AS c FROM d3 ORDER BY d DESC, vec_id LIMIT 1)
SELECT 0 AS place, vec_id FROM c0 UNION ALL SELECT 1 AS place, vec_id FROM c1 UNION ALL SELECT 2 AS place, vec_id FROM c2 UNION ALL SELECT 3 AS place, vec_id FROM c3 UNION ALL SELECT 4 AS place, vec_id FROM c4""",
    ),
    "formula_panel": (
        formula_panel,
        f"""
WITH {DAYS}, a AS (SELECT *, lag(value) OVER w AS prev, CASE WHEN count(value) OVER v = 5 THEN avg(value) OVER v END AS smooth FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day), v AS (PARTITION BY event_type ORDER BY day ROWS 4 PRECEDING))
SELECT event_type, day, round(value / prev - 1, 7) AS growth, round(smooth, 7) AS smooth, round(pow(value - smooth, 2) / volume, 7) AS excess, CAST(NULL AS DOUBLE) AS odd,
  CASE WHEN prev IS NULL THEN 'source_missing' END AS growth_reason, CASE WHEN smooth IS NULL THEN 'source_missing' END AS smooth_reason,
  CASE WHEN smooth IS NULL THEN 'source_missing' END AS excess_reason, CASE WHEN prev IS NULL THEN 'source_missing' ELSE 'zero_denominator' END AS odd_reason FROM a""",
    ),
    "vintage_snapshot": (
        vintage_snapshot,
        """
WITH v AS (SELECT user_id, event_type, CAST(ts AS DATE) AS known, arg_max(value, event_id) AS value FROM events GROUP BY ALL),
u AS (SELECT *, lead(known) OVER (PARTITION BY user_id, event_type ORDER BY known) AS until FROM v),
c AS (SELECT unnest([DATE '2024-01-05', DATE '2024-01-10', DATE '2024-01-15', DATE '2024-01-20', DATE '2024-01-25']) AS cut)
SELECT cut, event_type, count(*) AS versions, round(sum(value), 5) AS total, max(known) AS newest FROM u JOIN c ON known <= cut AND (until IS NULL OR until > cut) GROUP BY ALL""",
    ),
    "online_conformal": (
        online_conformal,
        f"""
WITH RECURSIVE {DAYS}, o AS (SELECT event_type, day, abs(value - 50.0) AS error, row_number() OVER (PARTITION BY event_type ORDER BY day) AS p FROM d),
r AS (SELECT event_type, day, p, error, CAST(0.0 AS DOUBLE) AS c FROM o WHERE p = 1
  UNION ALL SELECT o.event_type, o.day, o.p, o.error, r.c + 0.5 * (CASE WHEN r.error > 2.0 + r.c THEN 1.0 ELSE 0.0 END - (1 - CAST(0.9 AS DOUBLE))) FROM r JOIN o ON o.event_type = r.event_type AND o.p = r.p + 1)
SELECT event_type, day, round(2.0 + c, 6) AS radius FROM r""",
    ),
    "cusum_gate": (
        cusum_gate,
        """
WITH RECURSIVE d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(pow(value - 50, 2)), 6) AS s FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS p FROM d),
r AS (SELECT event_type, day, p, s AS q, CAST(0.0 AS DOUBLE) AS c FROM o WHERE p = 1
  UNION ALL SELECT o.event_type, o.day, o.p, CAST(0.9 AS DOUBLE) * r.q + (1 - CAST(0.9 AS DOUBLE)) * o.s, least(greatest(r.c + o.s / r.q - 1 - CAST(0.1 AS DOUBLE), 0), 3) FROM r JOIN o ON o.event_type = r.event_type AND o.p = r.p + 1)
SELECT event_type, day, round(c / 3, 6) AS gate, round(c, 6) AS cusum FROM r""",
    ),
    "reliability_signal": (
        reliability_signal,
        f"""
WITH RECURSIVE {DAYS}, o AS (SELECT event_type, day, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END AS up, row_number() OVER (PARTITION BY event_type ORDER BY day) AS p FROM d),
r AS (SELECT event_type, day, p, 0.5 * 0.9::DOUBLE + up * 0.1::DOUBLE AS slow, 0.25 + up * 0.5::DOUBLE AS fast FROM o WHERE p = 1
  UNION ALL SELECT o.event_type, o.day, o.p, r.slow * 0.9::DOUBLE + o.up * 0.1::DOUBLE, r.fast * 0.5::DOUBLE + o.up * 0.5::DOUBLE FROM r JOIN o ON o.event_type = r.event_type AND o.p = r.p + 1)
SELECT event_type, day, round(slow, 9) AS slow, round(fast, 9) AS fast FROM r""",
    ),
    "hmm_filter": (
        hmm_filter,
        f"""
WITH RECURSIVE {DAYS}, o AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, exp(-0.5 * pow((value - 46) / 6, 2)) AS g, exp(-0.5 * pow((value - 54) / 6, 2)) AS h FROM d),
r AS (SELECT event_type, i, day, h / (g + h) AS p, 0.0::DOUBLE AS change FROM o WHERE i = 1 UNION ALL
  SELECT o.event_type, o.i, o.day, (0.1 * (1 - p) + 0.9 * p) * h / ((0.9 * (1 - p) + 0.1 * p) * g + (0.1 * (1 - p) + 0.9 * p) * h),
    1 - 0.9 * ((1 - p) * g + p * h) / ((0.9 * (1 - p) + 0.1 * p) * g + (0.1 * (1 - p) + 0.9 * p) * h) FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
SELECT event_type, day, round(p, 7) AS high, round(change, 7) AS change FROM r""",
    ),
    "mature_mixture": (
        mature_mixture,
        f"""
WITH RECURSIVE {DAYS}, o AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, least(abs(42 - value) / 10, 1) AS l0, least(abs(50 - value) / 10, 1) AS l1, least(abs(58 - value) / 10, 1) AS l2 FROM d),
r AS (SELECT event_type, i, day, l0, l1, l2, 0.0::DOUBLE AS r0, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM o WHERE i = 1 UNION ALL
  SELECT o.event_type, o.i, o.day, o.l0, o.l1, o.l2, n.r0 + g - n.l0, n.r1 + g - n.l1, n.r2 + g - n.l2, n.c0 + abs(g - n.l0), n.c1 + abs(g - n.l1), n.c2 + abs(g - n.l2)
  FROM (SELECT *, w0 * l0 + w1 * l1 + w2 * l2 AS g FROM (SELECT *, CASE WHEN u0 + u1 + u2 > 0 THEN u0 / (u0 + u1 + u2) ELSE 1 / 3.0 END AS w0, CASE WHEN u0 + u1 + u2 > 0 THEN u1 / (u0 + u1 + u2) ELSE 1 / 3.0 END AS w1, CASE WHEN u0 + u1 + u2 > 0 THEN u2 / (u0 + u1 + u2) ELSE 1 / 3.0 END AS w2 FROM (SELECT *, greatest(0.5 * (exp(pow(greatest(r0 + 1, 0), 2) / (3 * (c0 + 1))) - exp(pow(greatest(r0 - 1, 0), 2) / (3 * (c0 + 1)))), 0) AS u0, greatest(0.5 * (exp(pow(greatest(r1 + 1, 0), 2) / (3 * (c1 + 1))) - exp(pow(greatest(r1 - 1, 0), 2) / (3 * (c1 + 1)))), 0) AS u1, greatest(0.5 * (exp(pow(greatest(r2 + 1, 0), 2) / (3 * (c2 + 1))) - exp(pow(greatest(r2 - 1, 0), 2) / (3 * (c2 + 1)))), 0) AS u2 FROM r))) n JOIN o ON o.event_type = n.event_type AND o.i = n.i + 1)
SELECT event_type, day, round(w0, 7) AS w0, round(w1, 7) AS w1, round(w2, 7) AS w2 FROM (SELECT *, CASE WHEN u0 + u1 + u2 > 0 THEN u0 / (u0 + u1 + u2) ELSE 1 / 3.0 END AS w0, CASE WHEN u0 + u1 + u2 > 0 THEN u1 / (u0 + u1 + u2) ELSE 1 / 3.0 END AS w1, CASE WHEN u0 + u1 + u2 > 0 THEN u2 / (u0 + u1 + u2) ELSE 1 / 3.0 END AS w2 FROM (SELECT *, greatest(0.5 * (exp(pow(greatest(r0 + 1, 0), 2) / (3 * (c0 + 1))) - exp(pow(greatest(r0 - 1, 0), 2) / (3 * (c0 + 1)))), 0) AS u0, greatest(0.5 * (exp(pow(greatest(r1 + 1, 0), 2) / (3 * (c1 + 1))) - exp(pow(greatest(r1 - 1, 0), 2) / (3 * (c1 + 1)))), 0) AS u1, greatest(0.5 * (exp(pow(greatest(r2 + 1, 0), 2) / (3 * (c2 + 1))) - exp(pow(greatest(r2 - 1, 0), 2) / (3 * (c2 + 1)))), 0) AS u2 FROM r))""",
    ),
    "portfolio_state": (portfolio_state, None),
    "leaderboard": (
        leaderboard,
        f"""
WITH RECURSIVE {DAYS}, o AS (SELECT event_type, day, value, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
r AS (SELECT event_type, i, day, round_even(value / 0.25, 0) * 0.25::DOUBLE AS best FROM o WHERE i = 1 UNION ALL
  SELECT o.event_type, o.i, o.day, CASE WHEN o.value < best - 0.25 THEN round_even(o.value / 0.25, 0) * 0.25 ELSE best END FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
SELECT event_type, day, round(best, 6) AS published FROM r""",
    ),
    "ridge_fit": (
        ridge_fit,
        """
WITH l AS (SELECT l_returnflag AS market, l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT market, a, b, y, avg(a) OVER w AS ma, avg(b) OVER w AS mb, avg(y) OVER w AS my FROM l WINDOW w AS (PARTITION BY market)),
s AS (SELECT market, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((a - ma) * (a - ma)) AS aa, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_ FROM m GROUP BY market),
p AS (SELECT market, ma, mb, my, aa + k AS aa, bb + k AS bb, ab, ay, by_, k AS penalty FROM s, (VALUES (1.0::DOUBLE), (1000.0)) v(k)),
c AS (SELECT market, penalty, ma, mb, my, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS u, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS v FROM p)
SELECT market, penalty, round(u, 6) AS quantity, round(v, 6) AS discount, round(my - u * ma - v * mb, 5) AS intercept FROM c""",
    ),
    "holm_adjustment": (
        holm_adjustment,
        """
WITH c AS (SELECT c_nationkey, c_custkey, (c_custkey * 37 % 101 + 1) / 2000.0::DOUBLE AS p FROM customer),
s AS (SELECT c_nationkey, c_custkey, p, (count(*) OVER (PARTITION BY c_nationkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) + 1) * p AS step FROM c)
SELECT c_nationkey, c_custkey, round(least(max(step) OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey ROWS UNBOUNDED PRECEDING), 1), 9) AS adjusted FROM s""",
    ),
    "sharpe_moments": (
        sharpe_moments,
        f"""
WITH {PANEL_SQL}, s AS (SELECT market, session, avg(target - prediction) AS r FROM panel GROUP BY ALL),
c AS (SELECT market, r, r - avg(r) OVER (PARTITION BY market) AS c FROM s)
SELECT market, round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS deviation, round(avg(c * c * c) / pow(avg(c * c), 1.5), 6) AS skewness, round(avg(c * c * c * c) / pow(avg(c * c), 2), 6) AS kurtosis, round(avg(r) / stddev_samp(r), 7) AS ratio FROM c GROUP BY ALL""",
    ),
    "net_returns_by_cost": (
        net_returns_by_cost,
        f"""
WITH {PANEL_SQL}, d AS (SELECT market, session, avg(sign(round(prediction, 6)) * target) AS g, avg(abs(prediction)) AS t FROM panel GROUP BY ALL)
SELECT market, bps, round(avg(g - bps / 1e4 * t), 9) AS net, count(*) FILTER (g - bps / 1e4 * t > 1e-9) AS days_up FROM d, (VALUES (0), (5), (20)) v(bps) GROUP BY ALL""",
    ),
    "estimability": (
        estimability,
        """
SELECT l_returnflag AS market, CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS stratum, count(*) AS rows, count(DISTINCT CAST(l_shipdate AS DATE)) AS sessions,
  CASE WHEN count(*) >= 500 AND count(DISTINCT CAST(l_shipdate AS DATE)) >= 300 THEN round(avg(l_tax), 9) END AS tax FROM lineitem GROUP BY 1, 2""",
    ),
    "fuzzy_memberships": (
        fuzzy_memberships,
        """
SELECT p_brand, CAST(k AS INTEGER) AS bucket, round(sum(greatest(0.0, 1 - abs((p_size - 1) / 49.0::DOUBLE * 4 - k))), 6) AS weight FROM part, range(5) t(k) GROUP BY ALL""",
    ),
    "hash_vector": (
        hash_vector,
        r"""
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s])')) AS w FROM benchmark),
h AS (SELECT item_id, CAST(('0x' || substr(sha256(w), 1, 7)) AS BIGINT) AS h FROM t)
SELECT item_id, h % 16 AS place, CAST(sum(CASE WHEN h // 16 % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM h GROUP BY ALL""",
    ),
    "masked_correlation": (
        masked_correlation,
        """
WITH d AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL)
SELECT a.event_type AS x, b.event_type AS y, count(*) AS n, CASE WHEN count(*) < 30 THEN 0 ELSE round(corr(a.v, b.v), 6) END AS correlation
FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY ALL""",
    ),
}
