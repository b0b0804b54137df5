"""Hand arithmetic and metamorphic rules: future rows, order and partitioning never change a result."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import formulas
from tidemark.operators import relational as R
from tidemark.operators import sequential as S
from tidemark.operators import vectors as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_keeps_null_latest_and_is_inclusive(spark):
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("a", 5, 5.0), ("b", 9, 9.0)], "k string, t long, v double")
    left = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 4), ("a", 5), ("b", 8), ("c", 1)], "k string, t long")
    found = R.asof_join(left, right, "t", ["k"], ["v"], "r_")
    assert rows(found) == sorted([("a", 0, None, None), ("a", 1, 1, 1.0), ("a", 2, 1, 1.0), ("a", 4, 3, None), ("a", 5, 5, 5.0), ("b", 8, None, None), ("c", 1, None, None)], key=repr)


def test_future_rows_and_order_change_nothing(spark, sf_dir):
    from tidemark.session import table

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    left, right = e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1").select("user_id", "ts", "value").dropDuplicates(["user_id", "ts"])
    make = lambda a, b: R.asof_join(a, b, "ts", ["user_id"], ["value"], "r_").where(F.col("ts") < cut).select("event_id", "r_at", "r_value")
    whole = make(left, right)
    for other in (make(left.where(F.col("ts") < cut), right.where(F.col("ts") < cut)), make(left.repartition(13).orderBy(F.sha2(F.col("event_id").cast("string"), 256)), right.repartition(1))):
        assert whole.exceptAll(other).count() == 0 and other.exceptAll(whole).count() == 0


def test_interval_join_bounds(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    left = spark.createDataFrame([("a", 1, t(10)), ("a", 2, t(0))], "k string, i int, t timestamp")
    right = spark.createDataFrame([("a", t(8), 1), ("a", t(8, 1), 2), ("a", t(10), 3), ("a", t(10, 1), 4)], "k string, at timestamp, j int")
    assert rows(R.interval_join(left, right, ["k"], "t", "at", 7200).select("i", "j")) == [(1, 2), (1, 3)]


def test_latest_revision_drops_disagreeing_keys(spark):
    f = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 2.0), ("b", 1, 1.0), ("b", 1, 3.0), ("c", 9, 1.0)], "k string, t long, v double")
    assert rows(R.latest_revision(f, ["k"], ["t"], "v", F.col("t") < 9)) == [("a", 2, 2.0)]


def test_calendar_and_grid(spark):
    days = spark.createDataFrame([(date(2024, 1, 30),), (date(2024, 2, 1),), (date(2024, 2, 5),)], "day date")
    assert rows(R.next_in_calendar(days, "day")) == sorted([(date(2024, 1, 30), date(2024, 2, 1)), (date(2024, 2, 1), date(2024, 2, 5)), (date(2024, 2, 5), None)], key=repr)
    g = R.dense_grid(spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 4), 4.0)], "k string, day date, v double"), ["k"], "day")
    filled = R.last_valid(g, ["k"], "day", "v", 1, "f")
    assert rows(filled.select(F.dayofmonth("day"), "v", "f")) == sorted([(1, 1.0, 1.0), (2, None, 1.0), (3, None, None), (4, 4.0, 4.0)], key=repr)


def test_midranks_and_tails(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0])] + [("o", 9, 5.0)], "k string, i int, v double")
    assert dict(df.select("i", C.midrank(["k"], "v")).collect()) == {0: 1.0, 1: 2.5, 2: 2.5, 3: 4.0, 9: 1.0}
    assert dict(df.select("i", C.scaled_midrank(["k"], "v")).collect())[9] == 0.0
    t = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 2.0, 3.0, 3.0])], "k string, i int, v double")
    assert dict(R.tail_weights(t, ["k"], "v", 25).select("i", "side").collect()) == {0: -1, 1: 0, 2: 0, 3: 0}


def test_quantiles_and_places(spark):
    df = spark.createDataFrame([("m", v, w) for v, w in ((1.0, 1.0), (2.0, 1.0), (3.0, 5.0))], "k string, v double, w double")
    assert rows(R.weighted_quantile(df, ["k"], "v", "w", 0.5, "q")) == [("m", 3.0)]
    assert rows(R.order_statistic(df, ["k"], "v", C.ceil_percent(F.col("_n") + 1, 50), "q")) == [("m", 3, 2.0)]


def test_correlation_states(spark):
    df = spark.createDataFrame([("few", 1.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, 6.0)], "k string, x double, y double")
    assert rows(R.session_correlation(df, ["k"], "x", "y", 3)) == sorted([("few", 1, "too_few", None), ("flat", 3, "x_constant", None), ("ok", 3, "defined", 1.0)], key=repr)


def test_numbers_are_parsed_exactly_or_not_at_all(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "-.5", "1e3", " 1", "1d", "NaN", "Infinity", "", "0x1", None)], "t string")
    assert [r[0] for r in df.select(C.exact_double(F.col("t"))).collect()] == [1.0, -0.5, 1000.0] + [None] * 7


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(R.Refused):
        R.require_unique(df, ["k"])
    with pytest.raises(R.Refused):
        R.require_columns(df, {"k": "int"})
    assert R.require_columns(df, {"k": "int", "v": "string"}) is df


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "w")], "k int, v string").unionByName(spark.createDataFrame([(5, "q")], "k int, v string"))
    assert dict(R.reconcile(a, b, ["k"], ["v"]).collect()) == {1: "equal", 2: "equal", 3: "left_only", 4: "right_only", 5: "right_only"}


def test_implied_probability_and_intervals(spark):
    levels = [0.025, 0.1, 0.5, 0.9, 0.975]
    for q, want in (([-2, -1, 0, 1, 2], 0.5), ([1, 2, 3, 4, 5], 0.975), ([-5, -4, -3, -2, -1], 0.025), ([-3, -2, -1, 1, 2], 0.3)):
        got = spark.range(1).select(C.implied_up_probability(levels, [F.lit(float(x)) for x in q])).first()[0]
        assert abs(got - want) < 1e-12
    pairs = C.narrow_widen(F.lit(0.0), [F.lit(2.0), F.lit(1.0)])
    assert tuple(spark.range(1).select(*[x for p in pairs for x in p]).first()) == (-2.0, 2.0, -2.0, 2.0)


def test_formulas(spark):
    panel = spark.createDataFrame([("a", i, float(v), w) for i, (v, w) in enumerate([(1, 0.0), (2, 1.0), (4, 2.0)])], "k string, p long, x double, y double")
    found = formulas.derive(panel, {"r": "x / y", "g": "x / x[p-1] - 1", "m": "mean(x[p-1:p])", "s": "(g + m) ^ 2"}, ["k"], "p").orderBy("p").collect()
    assert [r["r"] for r in found] == [None, 2.0, 2.0] and found[0]["r_reason"] == "zero_denominator"
    assert [r["g"] for r in found] == [None, 1.0, 1.0] and found[0]["g_reason"] == "source_missing"
    assert [r["m"] for r in found] == [None, 1.5, 3.0] and [r["s"] for r in found] == [None, 6.25, 16.0]
    with pytest.raises(formulas.FormulaError):
        formulas.derive(panel, {"a": "b + 1", "b": "a + 1"}, ["k"], "p")
    with pytest.raises(formulas.FormulaError):
        formulas.derive(panel, {"a": "__import__('os')"}, ["k"], "p")
    with pytest.raises(formulas.FormulaError):
        formulas.derive(panel, {"a": "x ^ 9"}, ["k"], "p")


def test_vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(90)]
    df = spark.createDataFrame(data, "id long, v array<double>, label int").repartition(4)
    m = np.array([r[1] for r in data])
    found = V.nearest(df, df.where("id % 10 = 0"), 2, "id", "v", block=4).collect()
    for q in range(0, 90, 10):
        s = m @ m[q]
        s[q] = -np.inf
        assert [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-s)[:2].tolist()
    est = {r["query_id"]: r["estimate"] for r in V.kernel_regression(df, df.where("id % 10 = 0"), "id", "v", "label", 0.01, block=4).collect()}
    for q in range(0, 90, 10):
        z = m @ m[q] / 0.01
        z[q] = -np.inf
        w = np.exp(z - z.max())
        assert abs(est[q] - (w * (np.arange(90) % 3)).sum() / w.sum()) < 1e-9
    chosen, least = [0], np.full(90, np.inf)
    for _ in range(3):
        least = np.minimum(least, ((m - m[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(least.argmax()))
    assert V.farthest_first(df, 0, 4, "id", "v") == chosen


def test_machines():
    c = S.OnlineConformal(0.5, 0.9)
    assert c.emit(1.0) == 1.0
    c.mature([2.0])
    assert abs(c.emit(1.0) - 1.45) < 1e-12
    g = S.Gate(0.0, 2.0, 0.5)
    assert g.update(1.0) == (0.0, 0.0) and g.update(2.0) == (0.5, 1.0) and g.square == 1.5
    h = S.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0], [4.0]]), np.array([[1.0], [1.0]]))
    p, change = h.update(np.array([4.0]))
    assert p[1] > 0.99 and change == 0.0
    p, change = h.update(np.array([0.0]))
    assert p[0] > 0.9 and change > 0.9
    m = S.Mixture(2)
    for _ in range(30):
        m.update(m.weights(), np.array([0.0, 1.0]))
    assert m.weights()[0] > 0.95
    b = S.Portfolio(100.0, sell_tax=0.01)
    b.orders = {"a": 5}
    assert b.session({"a": 10.0}, {"a": 12.0}, {"a": 3}) == {"value": 106.0, "cash": 70.0, "traded": 30.0, "taxes": 0.0, "unfilled": 1.0}
    b.orders = {"a": 0}
    assert b.session({"a": 10.0}, {"a": 10.0}, {"a": 9})["cash"] == pytest.approx(99.7)
    board = S.Leaderboard(0.1)
    assert [round(board.submit(x), 6) for x in (1.0, 0.95, 0.5)] == [1.0, 1.0, 0.5]


def test_formula_limits_and_growth(spark):
    panel = spark.createDataFrame([(1, 1, 4.0, 0.0), (1, 2, 8.0, -1.0), (1, 3, None, 2.0)], "k int, p int, x double, y double")
    found = formulas.derive(panel, {"g": "growth(x, 1)", "h": "growth(y, 1)", "i": "-x ^ 2 + 3 * (x - 1)", "j": "2 / y"}, ["k"], "p").orderBy("p").collect()
    assert [r["g_reason"] for r in found] == ["source_missing", None, "source_missing"] and abs(found[1]["g"] - 0.6931471805599453) < 1e-12
    assert [r["h_reason"] for r in found] == ["source_missing", "nonpositive_growth_input", "nonpositive_growth_input"]
    assert found[0]["i"] == -16 + 9 and found[0]["j_reason"] == "zero_denominator" and found[2]["j"] == 1.0
    for bad in ("x + 101", "x[p-53]", "x ^ 0", "x ^ 1.5", "x x", "(x", "x[p-1", "mean(x[p:p-1])", "x +", "p + 1", "x ** 2", "1e9 * x", "+".join(["x"] * 61), "x" * 501, "", None, 3):
        with pytest.raises(formulas.FormulaError):
            formulas.names_of(bad)
    assert formulas.closure({"a": "b + c", "b": "d", "z": "c"}, ["a"]) == {"a", "b", "c", "d"}


def test_nearest_ties_and_repeated_queries(spark):
    rows = [(i, [1.0, 0.0]) for i in reversed(range(51))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = V.nearest(df, df.where("id in (0, 50)").unionByName(df.where("id = 50")), 3, "id", "v", block=1, chunk=10).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert V.nearest(df.limit(0), df.limit(0), 3, "id", "v").collect() == []


def test_order_statistics_against_sorting(spark):
    import random

    rng = random.Random(6)
    rows = [(k, rng.choice([rng.randint(0, 30) / 7, rng.random()])) for k in "ab" for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    places = [(n, F.ceil(F.col("_n") * n / 100)) for n in (1, 37, 50, 99)]
    found = {(r["k"], r["p"]): (r["n"], r["v"]) for r in R.order_statistics(df, ["k"], "x", places, "v", "p").collect()}
    for k in "abc":
        xs = sorted(x for j, x in rows if j == k)
        for n in (1, 37, 50, 99):
            assert found[k, n] == (len(xs), xs[-(-len(xs) * n // 100) - 1])
    assert len(found) == 12
