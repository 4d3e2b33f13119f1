"""Records of streamed lines: as in a batch, and closed by silence, also after a restart."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from emberline.operators import framing
from emberline.sources.profiles import PROFILES
from emberline.streaming import records
from tests.framing_by_hand import ByHand
from tests.test_framing import BAD, logs

SCHEMA = "session_id string, line_no long, text string, at timestamp"
IS_BAD = lambda: F.when(F.col("text").isin(list(BAD)), 1).otherwise(0)


def arrive(spark, path, rows):
    data = [(s, k, t, at) for s, k, t, at in rows]
    frame = spark.createDataFrame(data, "session_id string, line_no long, text string, s double").selectExpr("session_id", "line_no", "text", "timestamp_millis(cast(s * 1000 as long)) as at")
    frame.coalesce(1).write.mode("append").parquet(path)


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def start(df, tmp_path, **trigger):
    return df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(**trigger).start(str(tmp_path / "out"))


def until_read(query, files):
    """Until so many batches had rows; a query with timers by the clock has always another batch, so it is never through."""
    until = time.time() + 90
    seen = set()
    while len(seen) < files and time.time() < until and query.exception() is None:
        seen |= {p["batchId"] for p in query.recentProgress if p["numInputRows"]}
        time.sleep(0.1)
    query.stop()
    assert query.exception() is None and len(seen) >= files


def found(spark, tmp_path):
    try:
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    except Exception:  # nothing is written yet
        return []


def test_batches_cut_anywhere_give_the_records_of_the_whole(spark, tmp_path):
    texts = logs(21, 2, 120)
    path = str(tmp_path / "in")
    for lo in range(0, 120, 40):
        arrive(spark, path, [(str(s), k, t, 0.0) for s, own in enumerate(texts) for k, t in reversed(list(enumerate(own))) if lo <= k < lo + 40] + [("0", 0, texts[0][0], 0.0)])
    slow = [replace(p, timeout_s=3600) for p in PROFILES]
    query = start(records.framed(read(spark, path), slow, garbage=IS_BAD()), tmp_path, processingTime="0 seconds")
    until_read(query, 3)
    hand = ByHand(PROFILES, garbage=BAD.__contains__)
    for session, own in enumerate(texts):
        wanted = [r for r in hand.run(own)[0]]
        got = [r[1:] for r in found(spark, tmp_path) if r[0] == str(session)]
        open_ = [r for r in wanted if r not in got]
        assert not [r for r in got if r not in wanted]
        # What is still open at the end has not been given.
        assert sum(r[2] for r in open_) == 0 or (open_[-1][1] == len(own) - 1 and sum(r[2] for r in open_) <= framing.LOOK_BACK + 90)


def test_silence_closes_records_held_lines_and_garbage_by_event_time(spark, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, [("a", 0, "Linux version 6.1.0", 1.0), ("a", 1, "Oops: 0000", 2.0), ("a", 2, "CPU: 1", 3.0), ("b", 0, "*** Booting Zephyr OS", 1.0), ("b", 1, "*** held", 2.0), ("c", 0, "\x01\x02\x03\x04", 2.0), ("d", 0, "Linux version 6.1.0", 3.0), ("d", 1, "Oops: 0000", 8.0)])
    arrive(spark, path, [("z", 0, "later", 9.0)])
    arrive(spark, path, [("z", 1, "much later", 14.5), ("d", 2, "CPU: 2", 14.0)])
    arrive(spark, path, [("z", 2, "and later", 15.0)])
    stream = read(spark, path).withWatermark("at", "0 seconds")
    query = start(records.framed(stream, PROFILES, event_time="at"), tmp_path, availableNow=True)
    query.awaitTermination(240)
    assert query.exception() is None
    got = {(r[0], r[1], r[2], r[9]) for r in found(spark, tmp_path)}
    assert ("a", 1, 2, "dead_air") in got  # ten seconds for the kernel
    assert ("b", 1, 1, "single") in got and ("c", 0, 0, "run_ended") in got
    assert not [r for r in got if r[0] == "d" and r[3] != "single"]  # it went on in time


def test_silence_by_the_clock_also_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, [("a", 0, "Linux version 6.1.0", 0.0), ("a", 1, "Oops: 0000", 0.0), ("a", 2, "CPU: 1", 0.0), ("b", 0, "*** Booting Zephyr OS", 0.0), ("b", 1, "*** held", 0.0), ("c", 0, "\x01\x02\x03\x04", 0.0)])
    quick = [replace(p, timeout_s=8) for p in PROFILES]
    query = start(records.framed(read(spark, path), quick), tmp_path, processingTime="0 seconds")
    until = time.time() + 90
    while not found(spark, tmp_path) and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert {(r[0], r[1]) for r in found(spark, tmp_path)} <= {("a", 0), ("b", 0), ("a", 1), ("b", 1), ("c", 0)}
    query = start(records.framed(read(spark, path), quick), tmp_path, processingTime="0 seconds")
    wanted = {("a", 0, 0, "single"), ("a", 1, 2, "dead_air"), ("b", 0, 0, "single"), ("b", 1, 1, "single"), ("c", 0, 0, "run_ended")}
    while len(found(spark, tmp_path)) < len(wanted) and time.time() < until:
        time.sleep(0.5)
    query.stop()
    got = [(r[0], r[1], r[2], r[9]) for r in found(spark, tmp_path)]
    assert sorted(got) == sorted(wanted)  # each once


@pytest.mark.parametrize("pinned", ["linux"])
def test_a_pinned_profile(spark, tmp_path, pinned):
    path = str(tmp_path / "in")
    arrive(spark, path, [("a", 0, "U-Boot 2024.01", 0.0), ("a", 1, "Oops: 0000", 0.0), ("a", 2, "x", 0.0)])
    query = start(records.framed(read(spark, path), PROFILES, pinned=pinned), tmp_path, processingTime="0 seconds")
    until_read(query, 1)
    assert [(r[1], r[2], r[5], r[9]) for r in found(spark, tmp_path)] == [(0, 0, "linux", "single"), (1, 1, "linux", "unrelated_line"), (2, 2, "linux", "single")]
