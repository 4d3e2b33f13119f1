"""Streams of log records: watches, increments and epochs, with checkpoints.

A stream has at least device, event_id (its position), at and template. Order is
the order of receipt; device clocks only label records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def watch(stream: DataFrame, name: str, condition: Column) -> DataFrame:
    """Hits of a durable watch. The query's checkpoint is the position it has scanned to."""
    return stream.where(condition).select(F.lit(name).alias("watch"), "device", "event_id", "at", "template")


def start_watch(stream: DataFrame, name: str, condition: Column, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes hits to Parquet. The file sink and the checkpoint make each hit appear once, also after a restart."""
    return watch(stream, name, condition).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def start_increments(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Per batch: device, template, delta, last_at, for a sink that is idempotent by batch number."""

    def each(batch: DataFrame, number: int) -> None:
        deltas = batch.groupBy("device", "template").agg(F.count(F.lit(1)).alias("delta"), F.max("at").alias("last_at"))
        sink(deltas, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str) -> DataFrame:
    """Records by device, template and time window; state is dropped behind the watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), "device", "template").agg(F.count(F.lit(1)).alias("n"))


class _Epochs(StatefulProcessor):
    """Numbers a device's epochs: a reset record begins the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.boot = handle.getValueState("boot", StructType([StructField("boot", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        boot = self.boot.get()[0] if self.boot.exists() else 0
        whole = pd.concat(list(rows)).sort_values("event_id")
        whole["boot"] = boot + whole["is_reset"].astype("int64").cumsum()
        self.boot.update((int(whole["boot"].iloc[-1]),))
        yield whole[["device", "event_id", "at", "template", "boot"]]

    def close(self) -> None:
        pass


def streaming_epochs(stream: DataFrame, is_reset: Column) -> DataFrame:
    """device, event_id, at, template, boot, with one number of state a device (transformWithState)."""
    kind = stream.schema["device"].dataType.simpleString()
    rows = stream.select("device", "event_id", "at", "template", is_reset.alias("is_reset"))
    return rows.groupBy("device").transformWithStateInPandas(
        _Epochs(), outputStructType=f"device {kind}, event_id long, at long, template string, boot long", outputMode="Append", timeMode="None"
    )


class _Coalesced(StatefulProcessor):
    """Lets a key through once a window; what is held back is counted in the next that goes."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("at", LongType()), StructField("held", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, held = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for now, number in pd.concat(list(rows)).sort_values(["at", "event_id"])[["at", "event_id"]].itertuples(index=False):
            if at is None or now - at >= self.window_ms:
                out.append((key[0], int(number), int(now), int(held)))
                at, held = int(now), 0
            else:
                held += 1
        self.last.update((at, held))
        if out:
            yield pd.DataFrame(out, columns=["device", "event_id", "at", "held"])

    def close(self) -> None:
        pass


def coalesced(stream: DataFrame, window_ms: int = 5000) -> DataFrame:
    """device, event_id, at, held: notifications with repeats of a device within the window counted, not sent."""
    kind = stream.schema["device"].dataType.simpleString()
    return stream.select("device", "event_id", "at").groupBy("device").transformWithStateInPandas(
        _Coalesced(window_ms), outputStructType=f"device {kind}, event_id long, at long, held long", outputMode="Append", timeMode="None"
    )
