import numpy as np
import pytest

from tidemark.functions import inference as I
from tidemark.operators import clusters as K
from tidemark.operators.relational import Refused


def test_statistics_by_hand():
    assert I.deflated_sharpe(0.0, 1, 1.0, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert I.deflated_sharpe(0.3, 50, 0.02, 250, 0.0, 3.0) < I.deflated_sharpe(0.3, 1, 0.02, 250, 0.0, 3.0)
    d = np.array([1.0, 2.0, 3.0, 4.0])
    assert I.diebold_mariano(d, 0) == pytest.approx(2.5 / (1.25 / 4) ** 0.5 * (3 / 4) ** 0.5)
    assert np.isnan(I.diebold_mariano(np.ones(5), 0))
    assert I.holm([0.01, 0.04, 0.03]).tolist() == pytest.approx([0.03, 0.06, 0.06])
    assert I.step_down([5.0, 0.1], np.zeros((9, 2))).tolist() == [0.1, 0.1]
    assert I.step_down([5.0, 0.1], np.full((9, 2), 1.0)).tolist() == [0.1, 1.0]
    low, high = I.family_intervals([0.0, 1.0], np.array([[0.1, 1.0], [-0.1, 1.0], [0.0, 1.0]]), 1.0)
    assert (low <= [0, 1]).all() and (high >= [0, 1]).all() and high[1] == 1.0
    assert [I.decide(*x, 0.1, 0.01) for x in ((-2, -1), (0.2, 0.3), (-0.05, 0.05), (-1, 0.05), (-1, 1), (0.0, 0.001))] == ["superior", "inferior", "equivalent", "non_inferior", "undecided", "not_interpretable"]


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 5, 10)])
    u = K.memberships(x, 3, 15)
    assert np.allclose(u.sum(axis=1), 1) and len(set(u.argmax(axis=1)[::20])) == 3 and (u.max(axis=1) > 0.9).all()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    label = K.linkage(d, 3)
    assert label.tolist() == [0] * 20 + [1] * 20 + [2] * 20
    m = K.medoids(d, 3)
    assert [i // 20 for i in m] == [0, 1, 2]
    best = min((d[[a, b]].min(axis=0).sum(), (a, b)) for a in range(60) for b in range(a))
    assert d[K.medoids(d, 2)].min(axis=0).sum() <= best[0] * 1.05
    e = K.embedding(rng.normal(size=(5, 40)), 2)
    assert e.shape == (5, 2)
    rows = [(i % 2, i, [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>")
    assert K.fuzzy_clusters(df, "k", "i", "v", 3).count() == 60
    assert {r["region"] for r in K.regions(df, "k", "i", "v", 4).collect()} == {0, 1, 2, 3}
    with pytest.raises(Refused):
        K.regions(df, "k", "i", "v", 4, most=10)


def test_noise_depends_on_the_counter_alone(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import noise

    assert noise.splitmix(np.array([0], np.uint64)).tolist() == [0xE220A8397B1DCDAF]  # the generator's first output from seed zero
    df = spark.range(4000).select("id", noise.uniform(F.col("id")).alias("u"), noise.normal(F.col("id")).alias("z"))
    again = spark.range(4000).repartition(7).select("id", noise.uniform(F.col("id")).alias("u"), noise.normal(F.col("id")).alias("z"))
    assert df.exceptAll(again).count() == 0
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.02 and 0 <= r[1] and r[2] < 1 and abs(r[3]) < 0.05 and abs(r[4] - 1) < 0.05
