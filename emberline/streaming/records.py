"""Framing of lines as they arrive, with timers for what silence ends.

The automaton is that of ``operators.framing``. Of a session the state between two lines is kept (a few hundred bytes: which profile is
active, what is open and since which line; no text), and a timer runs while something is open. When nothing has come for as long
as the active profile allows, an open record is closed (``dead_air``), held lines are let go as records of their own, and a run of garbage ends. State and timers
are in the checkpoint, so a restart neither loses nor repeats a record.

Time is the clock (``ProcessingTime``: the silence of a console is seen without further input), or that of a watermarked column (``EventTime``).

A session's lines have to arrive in order of line_no from batch to batch; within a batch they may come in any order. A line at or before the last one
that was framed is taken for a repetition and left out. The marks of a batch's lines, not their text, are held in a task at once, so the
source's limit of files or bytes a trigger bounds it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from emberline.operators import framing
from emberline.sources.profiles import Profile

_NAMES = ["first_line", "last_line", "n_lines", "kind", "profile", "stage", "epoch", "severity", "closed_by", "truncated", "retro_attached", "interleaved"]


class _Framer(StatefulProcessor):
    def __init__(self, dialects: framing.Dialects, event_time: bool):
        self.dialects, self.event_time = dialects, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("held", BinaryType())]))

    def _state(self) -> tuple[framing.State, framing.Boot, framing.Boot, int]:
        if self.held.exists():
            return pickle.loads(bytes(self.held.get()[0]))
        return (*framing._started(self.dialects), framing.Boot(), -(2**62))

    def _rows(self, key: tuple, sink: framing._Records) -> pd.DataFrame:
        line, profile, turn = sink.singles()
        name, boots = self.dialects.profiles, [boot for *_, boot in sink.turns]
        rows = sink.rows + [(k, k, 1, "line", name[p].name, boots[t].stage, boots[t].epoch, None, "single", False, 0, False) for k, p, t in zip(line.tolist(), profile.tolist(), turn.tolist(), strict=True)]
        out = pd.DataFrame(sorted(rows, key=lambda r: r[0]), columns=_NAMES)
        out["severity"] = out["severity"].astype("Int32")
        out.insert(0, "session_id", key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, boot, opened, last = self._state()
        batch = pd.concat([r.drop(columns="session_id") for r in rows]).sort_values("line_no", kind="stable").drop_duplicates("line_no")
        batch = batch[batch["line_no"] > last]
        if not len(batch):
            return
        small = lambda c: batch[c].to_numpy().astype(np.int16)
        marks = np.column_stack([small(f"m{k}") for k in range(len(self.dialects.profiles))])
        seg = framing.Segment(self.dialects, batch["line_no"].to_numpy().astype(np.int64), small("garbage"), small("banner"), small("claim"), marks)
        sink = framing._folded(seg, state, boot, opened)
        self.held.update((pickle.dumps((state, sink.boot, sink.open_boot, int(seg.line[-1]))),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if state.mode != "closed":
            now = int(batch["at_ms"].max()) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + 1000 * self.dialects.profiles[state.active].timeout_s)
        yield self._rows(key, sink)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, boot, opened, last = self._state()
        none = np.empty(0, dtype=np.int16)
        nothing = framing.Segment(self.dialects, np.empty(0, dtype=np.int64), none, none, none, np.empty((0, len(self.dialects.profiles)), dtype=np.int16))
        sink = framing._Records(nothing, state, boot, opened)
        framing.finish(sink, state, "dead_air", False)
        self.held.update((pickle.dumps((state, boot, opened, last)),))
        if sink.rows:
            yield self._rows(key, sink)

    def close(self) -> None:
        pass


def framed(stream: DataFrame, profiles: list[Profile], *, event_time: str | None = None, pinned: str | None = None, garbage: Column | None = None) -> DataFrame:
    """Records of a stream of lines (session_id, line_no, text), with the columns of ``framing.frame``.

    ``event_time`` names a watermarked timestamp, by which timers then run; else they run by the clock.
    """
    from pyspark.sql import functions as F

    dialects = framing.Dialects.of(profiles, pinned)
    more = [event_time] if event_time else []
    marked = framing.judged(stream, dialects, garbage, *more)
    if event_time:
        marked = marked.withColumn("at_ms", F.unix_millis(F.col(event_time)))
    kind = stream.schema["session_id"].dataType.simpleString()
    return marked.groupBy("session_id").transformWithStateInPandas(
        _Framer(dialects, event_time is not None), outputStructType=f"session_id {kind}, {framing._RESULT}", outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime"
    )
