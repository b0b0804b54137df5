"""The model against plain loops, and what it catches among rows that it never saw."""

import zlib

import numpy as np
import pytest

from tests.llm.helpers import documents
from tidemark.llm import toxicity as T

BIG = "/root/testdata/sf0.1"


def naive_margins(x, y, trees, depth=T.DEPTH):
    """The same boosting, a node at a time with lists of rows and every cut tried."""
    n, features = x.shape
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, T.BINS)[1:-1])) for f in range(features)]
    bins = [[sum(e < v for e in edges[f]) for v in x[:, f]] for f in range(features)]
    margin = [base] * n
    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p]

        def grow(rows, level):
            if level == depth:
                value = -T.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
                for i in rows:
                    margin[i] += value
                return
            best, split = 1e-9, None
            total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
            for f in range(features):
                own, where = -1.0, None
                for cut in range(T.BINS):
                    left = [i for i in rows if bins[f][i] <= cut]
                    if len(left) < T.LEAF or len(rows) - len(left) < T.LEAF:
                        continue
                    a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                    if gain > own + 1e-12:
                        own, where = gain, cut
                if where is not None and own > best + 1e-9:
                    best, split = own, (f, where)
            if split is None:
                return grow_all(rows, level)
            f, cut = split
            grow([i for i in rows if bins[f][i] <= cut], level + 1)
            grow([i for i in rows if bins[f][i] > cut], level + 1)

        def grow_all(rows, level):
            grow(rows, depth)

        grow(list(range(n)), 0)
    return np.array(margin)


def test_trees_against_plain_loops(monkeypatch):
    monkeypatch.setattr(T, "TREES", 4)
    monkeypatch.setattr(T, "BINS", 12)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 4)), 1)
    y = ((x[:, 0] + x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.4, size=160)) > 0.3).astype(float)
    assert np.allclose(T.Trees().fit(x, y).margins(x), naive_margins(x, y, 4), atol=1e-9)


def test_isotonic_is_the_best_rising_map():
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.normal(size=60)), (rng.random(60) < np.linspace(0.1, 0.9, 60)).astype(float)
    places, values = T.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(places) >= 0).all()
    want = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]  # max-min formula
    assert np.isclose(sorted(set(np.round(want, 12))), sorted(set(np.round(values, 12)))).all()


def test_features_by_hand():
    f = dict(zip(T.FEATURES, T.Features({"bad": 4.0, "wors*": 2.0}).of("You BAD b4d worse!! ok sooo")))
    assert (f["hits"], f["stems"], f["strong"], f["hidden"], f["weight"]) == (1, 1, 1, 1, 6.0)
    assert f["near_you"] == pytest.approx(1 / 2 + 1 / 4) and f["words"] == pytest.approx(np.log1p(6))


def test_query_rows_against_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = T.learned_from(spark, docs, "/root/testdata/sf0.01")
    want = {r["doc_id"]: float(model.scores([r["text"]])[0]) for r in docs.collect()}
    rows = T.op8_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-12) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_held_out_recall_and_false_alarms(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [r for r in T.op8_toxicity(spark, BIG).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [r for r in rows if labels[r["doc_id"]]]
    clean = [r for r in rows if not labels[r["doc_id"]]]
    assert len(toxic) > 50 and sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    a, b = (np.array([r["score"] for r in some]) for some in (toxic, clean))
    assert (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean() > 0.97


def test_a_column_of_the_scores_name_is_refused(spark):
    model = T.Model({}, 0.25)
    df = documents(spark)
    assert {r["toxicity"] for r in T.score(df, model).collect()} == {0.25}
    with pytest.raises(ValueError):
        T.score(df.withColumnRenamed("lang", "toxicity"), model)
