"""What several operators share: tables written to the cluster's shared folder, and Arrow batches cut to a bounded size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and text bytes that a Python worker turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20
#: Bytes after which Spark ends an Arrow batch.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, and a lost executor loses nothing.

    The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the folder of a table that `written` made and that nothing reads any more."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def hot_join(rows: DataFrame, side: DataFrame, key: str, most: int = 4096, least: int = 64) -> DataFrame:
    """rows joined with side, which has at most one row a key, on the column `key`; keys that many rows share don't meet in one task.

    The at most `most` keys with `least` rows or more, and over a hundred-thousandth of all, are
    counted with a map-side aggregation; their sides are broadcast, all others joined as usual.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    total = rows.count()
    hot = counts.where(F.col("_n") > total * 1e-5).orderBy(F.desc("_n"), key).limit(most).select(key)
    sides = written(side.join(F.broadcast(hot), key, "left_semi").coalesce(1), "hot")
    return rows.join(F.broadcast(sides), key).unionByName(rows.join(F.broadcast(sides.select(key)), key, "left_anti").join(side, key))


def bounded(df: DataFrame) -> DataFrame:
    """df, the session's Arrow batches being bounded by bytes beside rows from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def mapped(df: DataFrame, apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with bounded batches."""
    return bounded(df).mapInArrow(apply, schema)


def _parts(rows: int, nbytes: int, most: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of the rows of each piece."""
    step = max(1, min(most, size * rows // max(1, nbytes)))
    return ((at, step) for at in range(0, rows, step))


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text", most: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `most` rows and, but for single rows, about `size` bytes of text."""
    for batch in batches:
        for at, n in _parts(batch.num_rows, 0 if text is None else batch.column(text).nbytes, most, size):
            yield batch.slice(at, n)
        pa.default_memory_pool().release_unused()


def in_slices(array: pa.Array, apply: Callable[[list], pa.Array], kind: pa.DataType) -> pa.Array:
    """apply over the array's values, by the pieces that `slices` makes of batches."""
    return pa.concat_arrays([pa.array([], kind), *(apply(array.slice(at, n).to_pylist()) for at, n in _parts(len(array), array.nbytes))])


def signed(value: int) -> int:
    """An unsigned 64-bit value as Spark's LONG."""
    return value - (1 << 64) if value >> 63 else value


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None]) -> None:
    """Says in a Python worker that `owner` keeps something from task to task, and how to let go of it: whatever others hold is released, since workers outlive stages."""
    others = [k for k in _held if k != owner]
    for k in others:
        _held.pop(k)()
    _held[owner] = release
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps freed memory for itself
