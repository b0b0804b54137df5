"""Registered queries against their SQL on small tables of zeros, negative values and missing ones, where logarithms and ratios have no finite value."""

import math
import random
from datetime import datetime

import duckdb
import pytest

from tidemark.plans import registry


def exact(rows, columns):
    """Rows with NaN, infinite and missing values told apart."""
    one = lambda v: ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def against_sql(spark, folder, table, data, schema, name):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, want = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLE[name])
    found = exact([tuple(r) for r in df.collect()], df.columns)
    assert found == exact(want.fetchall(), want.columns)
    return found


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_candles_over_a_high_of_zero(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    values = [(1, 1, 0.0), (1, 2, 4.0), (1, 3, 0.0), (2, 1, -1.0), (2, 1, 0.0), (3, 1, None), (3, 2, 0.0), (4, 1, -2.0), (4, 2, -3.0), (4, 2, -1.0), (5, 1, float("nan"))]
    data = [(i, day(d, i), u, "view", v, None) for i, (u, d, v) in enumerate(values)]
    found = against_sql(spark, tmp_path, "events", data, EVENTS, "candle_geometry")
    assert len(found) == 9 and sum("nan" in r for r in found) >= 2 and any("inf" in r for r in found)


def odd_closes():
    """Users over twelve days, some days without the user; zeros, negative and missing values, equal times, negative users and a missing day."""
    rng, rows = random.Random(4), []
    for user in range(-3, 39):
        for day in range(1, 13):
            for _ in range(rng.choice([0, 1, 1, 2, 3]) if day % 6 == 0 else 1):
                value = rng.choice([0.0, 0.0, -1.5, None]) if rng.random() < (0.04, 0.5, 0.2)[user % 3] else rng.randint(1, 400) / 8
                rows.append((len(rows), datetime(2024, 1, day, rng.randint(0, 2)), user, "view", value, None))
    return rows + [(len(rows) + k, None, k, "view", 1.0, None) for k in range(3)]


def test_routes_of_odd_closes(spark, tmp_path):
    assert len(against_sql(spark, tmp_path, "events", odd_closes(), EVENTS, "regime_routes")) > 30


def test_routes_with_one_close_of_zero(spark, tmp_path):
    """Its asset counts, and its infinite fall decides nothing else."""
    data = [(10 * u + d, datetime(2024, 1, d), 3 * u, "view", 0.0 if (u, d) == (1, 5) else float(u + d), None) for u in range(4) for d in range(1, 6)]
    found = against_sql(spark, tmp_path, "events", data, EVENTS, "regime_routes")
    assert [r[0] for r in found] == ["0"] * 4 + ["4"]


def test_placebos_of_odd_closes(spark, tmp_path):
    assert len(against_sql(spark, tmp_path, "events", odd_closes(), EVENTS, "placebo_routes")) > 8


def test_a_missing_day_is_a_markets_last(spark, tmp_path):
    data = [(10 * u + d, datetime(2024, 1, d) if d < 10 else None, 3 * u, "view", float(u + (d * 7) % 5), None) for u in range(4) for d in range(1, 11)]
    against_sql(spark, tmp_path, "events", data, EVENTS, "placebo_routes")


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def test_prices_of_zero_are_on_the_grid(spark, tmp_path):
    """A price under half a fraction becomes zero where keys are divisible by 150; missing prices, days and keys, negative and NaN prices."""
    days = [datetime(1996, 3, 1), datetime(2000, 10, 1), datetime(2000, 12, 31), datetime(2001, 6, 1), datetime(2003, 1, 1), None]
    prices = [1001.91, 1953.0, 250_000.0, 0.0, 0.005, 10.125, 99.99, -5.0, -1500.0, None, float("nan")]
    data = [(k, 1, "O", p, d, "") for k in (0, 1, 3, 50, 150, None) for p in prices for d in days]
    found = against_sql(spark, tmp_path, "orders", data, ORDERS, "tick_concordance")
    assert len(found) == 5


def test_constants_of_odd_closes(spark, tmp_path):
    against_sql(spark, tmp_path, "events", [r for r in odd_closes() if r[1] and r[2] >= 0], EVENTS, "terminal_constants")
