"""Streaming jobs run to their end over the events table, and page parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table
from tidemark.sources import files
from tidemark.streaming import jobs


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows by type, computed as a stream."""
    done = jobs.to_end(jobs.tumbling(jobs.event_stream(spark, f"{sf_dir}/events.parquet"), "1 day", "6 hours", ["event_type"]))
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of six hours, computed as a stream."""
    done = jobs.to_end(jobs.sessions(jobs.event_stream(spark, f"{sf_dir}/events.parquet"), "1 day", "6 hours", ["user_id"]))
    return done.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first"), "events")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event id once, the events sent twice."""
    s = jobs.event_stream(spark, f"{sf_dir}/events.parquet")
    done = jobs.to_end(jobs.once_within(s.unionByName(s), "1 day", ["event_id"]).select("event_id", "event_type", "value"), "append")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 5).alias("total"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and body of the pages, from a parser."""
    p = files.parse_articles(table(spark, sf_dir, "pages"), "page_id", "html")
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.sum("links").alias("links"))


REGISTERED = {
    "stream_tumbling": (stream_tumbling, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL"),
    "stream_sessions": (
        stream_sessions,
        """
WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000, true) AS starts FROM events),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS first, count(*) AS events FROM s GROUP BY user_id, session""",
    ),
    "stream_once": (stream_once, "SELECT event_type, count(*) AS events, round(sum(value), 5) AS total FROM events GROUP BY ALL"),
    "page_articles": (page_articles, """SELECT regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS lang, count(*) AS pages, CAST(sum(len(regexp_extract_all(html, '<a [^>]*href="[^"]+"'))) AS BIGINT) AS links FROM pages GROUP BY ALL"""),
}
