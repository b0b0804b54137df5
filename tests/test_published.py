"""Outcomes published with the first decision at or after their maturity: bounds, spans without decisions, missing values, and work in proportion to the rows."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import replay as Y
from tidemark.plans import registry


def test_bounds_spans_and_missing_values(spark):
    t = lambda h, m=0: datetime(2024, 1, 1) + timedelta(hours=h, minutes=m)
    d = spark.createDataFrame([("a", t(1)), ("a", t(1)), ("a", t(1, 30)), ("a", t(5)), ("b", t(0)), ("a", None), (None, t(9))], "k string, at timestamp_ntz")
    o = [("a", t(0), 1), ("a", t(1), 2), ("a", t(1, 1), 3), ("a", t(1, 30), 4), ("a", t(1, 31), 5), ("a", t(3), 6), ("a", t(5), 7), ("a", t(5, 1), 8), ("b", t(0), 9), ("b", t(0, 1), 10), ("c", t(0), 11), ("a", None, 12), (None, t(0), 13)]
    r = Y.published_rewards(d, spark.createDataFrame(o, "k string, m timestamp_ntz, i int").repartition(5), "k", "at", "m", ["i"])
    assert r.columns == ["k", "m", "i", "published_at", "place"]
    found = {x["i"]: (x["published_at"], x["place"]) for x in r.collect()}
    want = {1: (t(1), 1), 2: (t(1), 2), 3: (t(1, 30), 1), 4: (t(1, 30), 2), 5: (t(5), 1), 6: (t(5), 2), 7: (t(5), 3), 9: (t(0), 1)}
    assert found == want | {i: (None, None) for i in (8, 10, 11, 12, 13)}


def test_other_spans_give_the_same(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    args = (e.where("event_id % 17 = 0").select("event_type", F.col("ts").alias("at")), e.select("event_type", "event_id", "ts"), "event_type", "at", "ts", ["event_id"])
    whole = Y.published_rewards(*args, span=lambda c: F.when(c.isNotNull(), 0))
    for other in (Y.published_rewards(*args), Y.published_rewards(*args, span=lambda c: F.unix_date(c.cast("date")))):
        assert whole.exceptAll(other).count() == 0 and other.exceptAll(whole).count() == 0


def test_no_frame_ends_with_its_partition(spark, sf_dir):
    """Spark goes through the rest of such a frame for each row."""
    assert "unboundedfollowing" not in registry.QUERIES["matured_rewards"](spark, sf_dir)._jdf.queryExecution().toString().lower()


def test_query_on_many_rows(spark, tmp_path):
    t = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 12_345_678).cast("timestamp_ntz")
    e = spark.range(200_000).select(F.col("id").alias("event_id"), t.alias("ts"), F.col("id").alias("user_id"), F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"), (F.col("id") % 1000 / 8.0).alias("value"), F.lit("").alias("props"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df, want = registry.QUERIES["matured_rewards"](spark, str(tmp_path)), con.sql(registry.ORACLE["matured_rewards"])
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())
