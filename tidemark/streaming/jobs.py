"""Structured Streaming jobs over event tables; availability is the event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.sequential import OnlineConformal
from tidemark.session import shared_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A Parquet table, a file or a folder, as a stream; the time column is cast for watermarks."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, late: str, length: str, keys: list[str], time: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums by key and window; rows later than the watermark count no more."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, late: str, gap: str, keys: list[str], time: str = "ts") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("events"))


def once_within(stream: DataFrame, late: str, keys: list[str], time: str = "ts") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class ConformalProcessor(StatefulProcessor):
    """Per market: a row's radius is emitted with the current correction and matures with the market's next instant.

    An instant is emitted once: rows of it, or of an earlier one, that come in a later micro-batch are late and dropped.
    """

    def __init__(self, rate: float, level: float, radius: float) -> None:
        self.rate, self.level, self.radius = rate, level, radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("conformal", "correction double, used double, error double, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        ordered = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        machine = OnlineConformal(self.rate, self.level, held[0] if held else 0.0)
        before, last_at = None, held[3] if held else None
        if held:
            ordered = ordered[ordered["at"] > pd.Timestamp(held[3])]
            machine.pending.append((held[1], self.radius))
            before = held[2]
        out = []
        for at, group in ordered.groupby("at", sort=True):
            if before is not None:
                machine.mature([before])
            used = machine.emit(self.radius)
            before, last_at = float(group["error"].mean()), at
            out.append((key[0], at, used))
            last = used
        if out:
            self.state.update((machine.correction, last, before, pd.Timestamp(last_at).to_pydatetime()))
        yield pd.DataFrame(out, columns=["market", "at", "radius"])

    def close(self) -> None:
        pass


def online_conformal(stream: DataFrame, rate: float = 0.5, level: float = 0.9, radius: float = 2.0) -> DataFrame:
    """stream: market, at, id, error; within a micro-batch rows are taken in time order."""
    return stream.groupBy("market").transformWithStateInPandas(ConformalProcessor(rate, level, radius), "market string, at timestamp, radius double", "append", "none")


def to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result, read from the shared folder; the driver holds none of it.

    Every micro-batch is written under its number, so that one which is run again replaces itself; a
    complete result is the last batch's, an appended one that of all.
    """
    spark = stream.sparkSession
    path = shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(f"{path}/result")
    if mode == "complete":
        done = done.where(F.col("batch") == done.agg(F.max("batch")).first()[0])
    return done.drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
