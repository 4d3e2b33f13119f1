"""Following a stream until something happens: the first of several rules that holds, for each device.

Rules, in the order in which they are listed: a condition on a record (a pattern, a stage that is entered, a prompt, a reset, a watch's condition), a template that the
device has not shown before, or silence of some length. Records are judged by column expressions; of a device its last position and time are kept, whether it has
matched, and, if a rule asks for it, the templates that it has shown. A timer runs for silence, by the clock or by the stream's own time. A device matches once; of
several rules that one record satisfies the first listed counts, and silence before a record comes before what the record satisfies. All of it is in the checkpoint.

Records have to arrive in order of event_id from batch to batch; within a batch they may come in any order. A record at or before the last position is a repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Until:
    """A rule: a condition on a record's columns, ``new`` for a template that is new to the device, or milliseconds of silence."""

    label: str
    condition: Column | None = None
    new: bool = False
    quiet_ms: int | None = None


class _First(StatefulProcessor):
    def __init__(self, labels: list[str], new: int | None, quiet: tuple[int, int] | None, event_time: bool):
        self.labels, self.new, self.quiet, self.event_time = labels, new, quiet, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = StructType([StructField("event_id", LongType()), StructField("at", LongType()), StructField("done", BooleanType())])
        self.last = handle.getValueState("last", kind)
        if self.new is not None:
            self.seen = handle.getMapState("seen", StructType([StructField("template", StringType())]), StructType([StructField("seen", BooleanType())]))

    def _hit(self, key: tuple, rule: int, event_id: int, at: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], self.labels[rule], event_id, at)], columns=["device", "rule", "event_id", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        position, before, done = self.last.get() if self.last.exists() else (None, None, False)
        if done:
            for _ in rows:
                pass
            return
        batch = pd.concat(list(rows)).sort_values("event_id", kind="stable").drop_duplicates("event_id")
        found = None
        for event_id, at, rule, template in zip(batch["event_id"], batch["at"], batch["rule"], batch["template"], strict=True):
            if position is not None and event_id <= position:
                continue
            if self.quiet and before is not None and at - before >= self.quiet[1]:
                found = (self.quiet[0], position, before + self.quiet[1])
                break
            position, before = int(event_id), int(at)
            held = int(rule)
            if self.new is not None and template is not None and not self.seen.containsKey((template,)):
                self.seen.updateValue((template,), (True,))
                held = self.new if held < 0 else min(held, self.new)
            if held >= 0:
                found = (held, position, before)
                break
        if position is not None:
            self.last.update((position, before, found is not None))
        for timer in self.handle.listTimers() if self.quiet else ():
            self.handle.deleteTimer(timer)
        if found:
            yield self._hit(key, *found)
        elif self.quiet and position is not None:
            now = before if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.quiet[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        position, before, done = self.last.get()
        if not done:
            self.last.update((position, before, True))
            yield self._hit(key, self.quiet[0], position, before + self.quiet[1])

    def close(self) -> None:
        pass


def until(stream: DataFrame, rules: list[Until], *, event_time: str | None = None) -> DataFrame:
    """device, rule, event_id, at of each device's first match, from a stream with device, event_id, at (milliseconds), template and what conditions ask for.

    Of silence event_id is the last record before it, and at the time at which it was long enough. ``event_time`` names a watermarked timestamp that goes with ``at``; else
    silence at the end is measured by the clock.
    """
    rule = F.lit(-1)
    for k, r in reversed(list(enumerate(rules))):
        if r.condition is not None:
            rule = F.when(r.condition, k).otherwise(rule)
    new = next((k for k, r in enumerate(rules) if r.new), None)
    quiet = next(((k, r.quiet_ms) for k, r in enumerate(rules) if r.quiet_ms is not None), None)
    kind = stream.schema["device"].dataType.simpleString()
    rows = stream.select("device", "event_id", "at", "template", rule.alias("rule"), *([event_time] if event_time else []))
    return rows.groupBy("device").transformWithStateInPandas(
        _First([r.label for r in rules], new, quiet, event_time is not None), outputStructType=f"device {kind}, rule string, event_id long, at long",
        outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime" if quiet else "None",
    )
