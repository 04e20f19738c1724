"""Structured Streaming: delayed labels, drift detection with state, event-time summaries, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trivane.functions.expressions import region
from trivane.operators.drift import Detector, DetectorConfig


#: Fixed value: the class that Spark names for state kept in RocksDB.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DriftProcessor(StatefulProcessor):
    """One key's detector: its window of values as a list, the number of its next value and the place of its last event as a value.

    With ``idle`` milliseconds a timer of a key that has seen no row for so long clears its state; the key begins anew after that.
    """

    def __init__(self, config: DetectorConfig, key: str, idle: int = 0):
        self.config, self.key, self.idle = config, key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "value double")
        self.place = handle.getValueState("place", "next long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [f.iloc[:, -2:].to_numpy() for f in rows]  # time and value of each row of this micro-batch
        new = np.concatenate(parts)
        new = new[np.lexsort((new[:, 1].astype(float), new[:, 0].astype("int64")))]
        index, last = self.place.get() if self.place.exists() else (0, -1)
        detector = Detector(self.config, [v for (v,) in self.values.get()], None if last < 0 else last)
        out = []
        for v in new[:, 1].astype(float).tolist():
            if (found := detector.update(v, index)) is not None:
                out.append((key[0], index, found))
            index += 1
        self.values.put([(v,) for v in detector.values])
        self.place.update((index, -1 if detector.last is None else detector.last))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=[self.key, "index", "value"])

    def handleExpiredTimer(self, key: tuple, timer: TimerValues, expired: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.place.clear()
        yield pd.DataFrame([], columns=[self.key, "index", "value"])

    def close(self) -> None:
        pass


def detect_stream(stream: DataFrame, key: str, time: str, value: str, config: DetectorConfig = DetectorConfig(), idle: int = 0) -> DataFrame:
    """key, index, value of drift events. State holds a key's last values; rows of a micro-batch are taken in the order of time and value, null values are left out.

    State lives in RocksDB under the query's checkpoint, so that a stream that is stopped and started again goes on where it was. A source that limits
    the files or bytes of a micro-batch bounds what is held of a key at once.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.select(key, micros.alias("__time"), F.col(value).cast("double").alias("__value")).where("__value is not null")
    return rows.groupBy(key).transformWithStateInPandas(DriftProcessor(config, key, idle), f"`{key}` {kind}, index bigint, value double", "Append", "ProcessingTime" if idle else "None")


def window_summary(stream: DataFrame, time: str, value: str, keys: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """keys, start, n, mean of event-time windows; rows later than ``late`` are not counted."""
    rows = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    out = rows.groupBy(F.window("__time", width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(*keys, F.col("window.start").alias("start"), "n", "mean")


def with_late_labels(scored: DataFrame, labels: DataFrame, key: str, scored_time: str, label_time: str, wait: str = "31 days", late: str = "31 days") -> DataFrame:
    """Scored rows joined with labels that arrive up to ``wait`` after them, and waited long (whole days), by a stream-stream join.

    ``late`` is how far the rows of either stream may be out of order; with it and the interval, state of either side is
    dropped once no partner can come any more. Rows that come later than that are not joined.
    """
    s = scored.withColumn("__s", F.col(scored_time).cast("timestamp")).withWatermark("__s", late)
    y = labels.select(F.col(key).alias("__key"), "label", F.col(label_time).cast("timestamp").alias("__y")).withWatermark("__y", late)
    both = s.join(y, F.expr(f"{key} = __key and __y >= __s and __y <= __s + interval {wait}"))
    return both.withColumn("waited", F.datediff("__y", "__s").cast("long")).drop("__key", "__s", "__y")


def decide_stream(stream: DataFrame, p: str, alpha: float, beta: float) -> DataFrame:
    return stream.withColumn("region", region(p, alpha, beta))


def write_batches(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append each micro-batch as a folder of its own, so that one that is repeated after a failure replaces itself."""

    def put(batch: DataFrame, epoch: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
