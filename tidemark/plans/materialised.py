"""Samples from the events table: a user's day is a decision at six in the evening; types stand for modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import samples as M
from tidemark.session import instants, table


def _evening(day):
    return day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(18))


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = instants(table(spark, sf_dir, "events"), "ts").withColumn("day", F.col("ts").cast("date"))
    prices = e.groupBy("user_id", "day").agg(F.max("value").alias("close"))
    p = M.windows(prices, "user_id", "day", ["close"], 5, 4).withColumn("at", _evening(F.col("day"))).drop("day")
    news = M.news_of(p.select("user_id", "at"), e.where("event_type = 'click'").select("user_id", "ts", "value"), "user_id", "at", "ts", 3, [F.count(F.lit(1)).alias("mentions"), F.round(F.max("value"), 6).alias("largest")])
    facts = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("value"))
    charts = e.where("event_type = 'view'").groupBy("user_id", _evening(F.col("day")).alias("at")).agg(F.count(F.lit(1)).alias("frames"))
    context = e.where("event_type = 'error'").groupBy(_evening(F.col("day")).alias("at")).agg(F.round(F.avg("value"), 6).alias("level"))
    return M.materialised(p, news, facts, charts, context, "user_id", "at", ["news", "facts", "charts"])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that have all modalities, with what a model would read of them."""
    s = sample_rows(spark, sf_dir).where(F.size("absent") == 0)
    last = F.element_at("window", -1)["close"]
    return s.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "present", F.round(F.log(F.when(last > 0, last)), 7).alias("level"), "news.mentions", "news.largest", F.col("facts.fact_value").alias("fact"), "charts.frames", "context_level")


def sample_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by what they lack."""
    s = sample_rows(spark, sf_dir)
    return s.groupBy(F.array_join("absent", "+").alias("absent")).agg(F.count(F.lit(1)).alias("decisions"), F.countDistinct("user_id").alias("assets"))


SAMPLES = """e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), p AS (SELECT user_id, day, max(value) AS close FROM e GROUP BY ALL),
w AS (SELECT a.user_id, CAST(a.day AS TIMESTAMP) + INTERVAL 18 HOUR AS t, CAST(count(*) AS INTEGER) AS present, max(CASE WHEN b.day = a.day THEN b.close END) AS close FROM p a JOIN p b ON b.user_id = a.user_id AND b.day BETWEEN a.day - 4 AND a.day GROUP BY ALL HAVING count(*) >= 4),
n AS (SELECT w.user_id, w.t, count(*) AS mentions, round(max(value), 6) AS largest FROM w JOIN e ON e.user_id = w.user_id AND event_type = 'click' AND ts <= t AND ts > t - INTERVAL 3 DAY GROUP BY ALL),
f AS (SELECT user_id, ts, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY ALL),
k AS (SELECT w.user_id, w.t, arg_max(f.value, f.ts) AS fact FROM w JOIN f ON f.user_id = w.user_id AND f.ts <= t GROUP BY ALL),
c AS (SELECT user_id, CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR AS t, count(*) AS frames FROM e WHERE event_type = 'view' GROUP BY ALL),
m AS (SELECT CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR AS t, round(avg(value), 6) AS level FROM e WHERE event_type = 'error' GROUP BY ALL),
s AS (SELECT w.*, mentions, largest, fact, frames, (SELECT arg_max(level, m.t) FROM m WHERE m.t <= w.t) AS context_level, k.user_id IS NOT NULL AS has_fact FROM w LEFT JOIN n ON n.user_id = w.user_id AND n.t = w.t LEFT JOIN k ON k.user_id = w.user_id AND k.t = w.t LEFT JOIN c ON c.user_id = w.user_id AND c.t = w.t)"""

REGISTERED = {
    "samples": (
        samples,
        f"""
WITH {SAMPLES} SELECT user_id, t AS "at", present, CASE WHEN close > 0 THEN round(ln(close), 7) END AS level, mentions, largest, fact, frames, context_level FROM s WHERE mentions IS NOT NULL AND has_fact AND frames IS NOT NULL""",
    ),
    "sample_absences": (
        sample_absences,
        f"""
WITH {SAMPLES}, a AS (SELECT user_id, concat_ws('+', CASE WHEN mentions IS NULL THEN 'news' END, CASE WHEN NOT has_fact THEN 'facts' END, CASE WHEN frames IS NULL THEN 'charts' END) AS absent FROM s)
SELECT absent, count(*) AS decisions, count(DISTINCT user_id) AS assets FROM a GROUP BY ALL""",
    ),
}
