import math
import random

import pytest

from tidemark.llm import norm_search as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, queries, k=10):
    rows = [(i, [math.floor(v * 1024) if abs(v) < 2**50 else int(v) * 1024 for v in x]) for i, x in ok(rows)]
    queries = [(i, [math.floor(v * 1024) if abs(v) < 2**50 else int(v) * 1024 for v in x]) for i, x in ok(queries)]
    out = []
    for i, q in queries:
        others = list(rows)
        others.remove((i, q))
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in others if len(c) == len(q))[:k]
        out += [(i, r, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def ok(rows):
    return [(i, x) for i, x, *_ in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]


def check(spark, rows, modulus, k=10, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = df.where(f"vec_id % {modulus} = 0")
    found = sorted(map(tuple, N.search(df, queries, k, **more).collect()))
    assert found == brute(rows, [r for r in rows if r[0] is not None and r[0] % modulus == 0], k)


@pytest.mark.parametrize("spread", [0.01, 3.0])
def test_random_vectors(spark, spread):
    rng = random.Random(spread)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(2500):
        scale = math.exp(rng.gauss(0, spread / 2))
        rows.append((i, [(c + rng.gauss(0, 0.2)) * scale for c in rng.choice(centres)], 1))
    check(spark, rows, 50)
    check(spark, rows[:300], 7, 3, block_values=12 * 9)
    check(spark, rows, 50, slab=300, cell=20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, 4.0], 2), (1, [1.0, 2.0], None), (2, None, 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [1.0, inf], 1), (None, [9.0, 9.0], 1), (6, [], 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [-5.0, -5.0], 1), (11, [1e300, -1e300], 1), (12, [1e12, 2e12], 1), (13, [1e-300, -1e-300], 1)]
    check(spark, rows, 1)
    check(spark, [r for r in rows if r[0] not in (11, 12)], 1, 2)


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert N.search(empty, empty).collect() == []
    df = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(9)], SCHEMA)
    other = df.withColumns({c: F.lit("x") for c in ("id", "x", "dim", "norm", "block", "q", "rank", "score", "own", "gone", "place")})
    assert sorted(map(tuple, N.search(other, other).collect())) == brute([tuple(r) for r in df.collect()], [tuple(r) for r in df.collect()])


def test_ties_of_a_common_vector(spark):
    rows = [(i, [1.0, 1.0, 0.5], 1) if i % 3 else (i, [math.sin(i), math.cos(i), 0.1], 1) for i in range(900)]
    check(spark, rows, 100)
