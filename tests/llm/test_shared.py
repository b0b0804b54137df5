from pyspark.sql import functions as F

from tidemark.llm import _shared


def test_hot_join_equals_a_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("k"), "id")
    side = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = _shared.hot_join(rows, side, "k", least=20)
    want = rows.join(side, "k")
    assert found.columns == want.columns
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0


def test_written_tables_go_when_dropped(spark):
    df = _shared.written(spark.range(5).toDF("x"), "test")
    assert df.count() == 5
    path = df.inputFiles()[0]
    _shared.drop_written(df)
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100_000] * 200 + [None] * 3})
    parts = list(_shared.slices(iter([batch])))
    assert sum(p.num_rows for p in parts) == 203
    assert all(p.num_rows <= 90 for p in parts)


def test_only_one_owner_keeps_its_cache():
    from tidemark.llm import _shared as S

    let_go = []
    S.claim("a", lambda: let_go.append("a"))
    S.claim("a", lambda: let_go.append("a2"))
    assert let_go == []
    S.claim("b", lambda: let_go.append("b"))
    assert let_go == ["a2"]
    S._held.clear()


def test_slices_of_arrays_keep_order_and_nulls():
    import pyarrow as pa

    from tidemark.llm import _shared as S

    values = [None if i % 7 == 0 else "x" * (i % 50) for i in range(2000)]
    sizes = []

    def apply(texts):
        sizes.append(len(texts))
        return pa.array([t and t.upper() for t in texts], pa.string())

    assert S.in_slices(pa.array(values), apply, pa.string()).to_pylist() == [v and v.upper() for v in values]
    assert max(sizes) <= S.SLICE_ROWS and S.in_slices(pa.array([], pa.string()), apply, pa.string()).to_pylist() == []
