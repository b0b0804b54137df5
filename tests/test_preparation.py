"""Preparation of many assets, blocks and cursors, encoders, consumers, anchored centres."""

from datetime import date
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import preparation as Z
from tidemark.operators import replay as Y
from tidemark.operators.relational import Refused
from tidemark.streaming import jobs


def test_cohorts_resume_and_capture_failures(spark, tmp_path):
    def prepare(asset):
        if asset == "b":
            raise OSError("no source")
        return spark.range(3).withColumn("asset", F.lit(asset))

    first = Z.prepare_cohort(["a", "b"], prepare, f"file://{tmp_path}", spark)
    assert {r["asset"]: r["state"] for r in first.collect()} == {"a": "prepared", "b": "failed"}
    calls = []
    again = Z.prepare_cohort(["a", "b", "c"], lambda x: calls.append(x) or spark.range(1), f"file://{tmp_path}", spark, first)
    assert calls == ["b", "c"] and {r["asset"]: r["state"] for r in again.collect()} == dict.fromkeys("abc", "prepared")


def test_blocks_and_cursors(spark, tmp_path):
    df = spark.createDataFrame([("m", date(2024, 1, d), float(d)) for d in range(1, 8)], "market string, day date, x double")
    Z.write_blocks(df, f"file://{tmp_path}/b", "market", "day", 3)
    assert sorted(r["x"] for r in Z.read_block(spark, f"file://{tmp_path}/b", 1, ["x"]).collect()) == [4.0, 5.0, 6.0]
    cursor, seen = None, []
    for block, after in Z.replay_blocks(spark, f"file://{tmp_path}/b", ["day"], None, ["day", "x"]):
        seen += [r["x"] for r in block.collect()]
        if cursor is None:
            cursor = after
    assert seen == [float(d) for d in range(1, 8)] and cursor[0] == 1
    rest = [r["x"] for block, _ in Z.replay_blocks(spark, f"file://{tmp_path}/b", ["day"], cursor, ["day", "x"]) for r in block.collect()]
    assert rest == [4.0, 5.0, 6.0, 7.0]
    with pytest.raises(Refused):
        next(Z.replay_blocks(spark, f"file://{tmp_path}/b", ["day"], (1, "other"), ["day", "x"]))


def test_a_stream_resumes_at_its_checkpoint(spark, tmp_path):
    """What was confirmed isn't read again: a second run takes the new file only."""
    source, seen = tmp_path / "in", []
    for n in range(2):
        spark.createDataFrame([(n * 2 + i, float(i)) for i in range(2)], "id long, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = jobs.event_stream(spark, f"file://{source}/")
        query = stream.select("id").writeStream.foreachBatch(lambda df, _: seen.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    assert seen == [[0, 1], [2, 3]]


def test_monthly_tables(spark):
    a = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 31), 2.0)], "day date, close double")
    b = spark.createDataFrame([(date(2024, 1, 31), 2.0), (date(2024, 2, 1), 3.0)], "day date, close double")
    assert Z.monthly_index([a, b], "day", ["close"]).count() == 3
    with pytest.raises(Refused):
        Z.monthly_index([a, b.withColumn("close", F.col("close") + 1)], "day", ["close"])


def test_encoders_and_consumers(spark):
    e = Z.Encoders(8)
    df = spark.createDataFrame([(1, "One two two"), (2, ""), (3, "two one TWO")], "id int, text string")
    v = {r["id"]: np.array(r["v"]) for r in df.select("id", e.text(F.col("text")).alias("v")).collect()}
    assert np.allclose(v[1], v[3]) and np.isclose(np.linalg.norm(v[1]), 1) and not v[2].any()
    window = spark.createDataFrame([(1, [(1.0, 4.0, 0.5, 2.0), (2.0, 3.0, 2.0, 3.0)])], "id int, w array<struct<open:double,high:double,low:double,close:double>>")
    assert window.select(e.chart(F.col("w")).alias("v")).first()["v"] == [0.25, 1.0, 0.125, 0.5, 0.5, 0.75, 0.5, 0.75]
    found = Z.consume(df.withColumn("secret", F.lit(1)), ["text"], ["id"], lambda view: view.select("id", F.length("text").alias("n"), F.lit("secret" in view.columns).alias("seen")))
    assert {(r["id"], r["n"], r["seen"]) for r in found.collect()} == {(1, 11, False), (2, 0, False), (3, 11, False)}
    with pytest.raises(Refused):
        Z.consume(df, ["text"], ["id"], lambda view: view.where("id > 1"))
    rows = spark.createDataFrame([(0.05, 1.0), (-0.01, -1.0)], "s double, h double")
    assert [tuple(r) for r in rows.select(*[Z.policy(p, F.col("s"), F.col("h")) for p in ("hold", "follow", "confident")]).collect()] == [(1.0, 1.0, 1.0), (-1.0, -1.0, -1.0)]
    with pytest.raises(Refused):
        Z.policy("learned", F.col("s"), F.col("h"))


def test_anchored_centres_are_locally_best(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(14, 2)) * 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    cost = lambda some: d[[0, 5, *some]].min(axis=0).sum()
    found = Z.anchored(d, [0, 5], 2)
    assert not {0, 5} & set(found) and len(found) == 2
    for a in found:
        for b in set(range(14)) - {0, 5, *found}:
            assert cost(sorted({*found} - {a} | {b})) >= cost(found) - 1e-9
    best = min(cost(c) for c in combinations(sorted(set(range(14)) - {0, 5}), 2))
    assert cost(found) <= best * 1.2
    df = spark.createDataFrame([("k", i, [float(v) for v in x[i]], i in (0, 5)) for i in range(14)], "k string, id int, v array<double>, fixed boolean")
    rows = {(r["id"], r["kind"]) for r in Z.anchored_medoids(df, "k", "id", "v", "fixed", 2).collect()}
    assert rows == {(0, "fixed"), (5, "fixed"), *((i, "chosen") for i in found)}


def test_memberships_sum_to_one(spark):
    df = spark.createDataFrame([(1, i, float(i % 4) if i else None) for i in range(9)], "s int, i int, x double")
    for r in Z.session_memberships(df, ["s"], ["x"], 3).collect():
        assert sum(r["x_weights"]) == pytest.approx(0.0 if r["x"] is None else 1.0)


def test_audit_refuses_a_plan_that_sees_the_future(spark):
    df = spark.createDataFrame([("k", d, float(d)) for d in range(6)], "k string, d int, x double")
    leak = lambda t: t.selectExpr("k", "d", "lead(x) over (partition by k order by d) as y")
    past = lambda t: t.selectExpr("k", "d", "lag(x) over (partition by k order by d) as y")
    args = (df, "d", ["x"], ["k", "d"], [2], {"zero": lambda c: F.lit(0.0)})
    assert Y.past_only(Y.ledger_audit(past, *args)).where("changed = 0").count() == 2
    with pytest.raises(Refused):
        Y.past_only(Y.ledger_audit(leak, *args))
