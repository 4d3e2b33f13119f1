"""Streams over files: watches, increments, epochs and coalescing agree with batches."""

import pytest
from pyspark.sql import functions as F

from emberline.streaming import increments

SCHEMA = "device string, event_id long, at long, template string"
ROWS = [("a", 1, 0, "boot"), ("a", 2, 1000, "x"), ("b", 3, 1500, "x"), ("a", 4, 2000, "boot"), ("a", 5, 9000, "err"), ("b", 6, 9500, "boot"), ("b", 7, 9900, "err")]


@pytest.fixture
def stream(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(0, len(ROWS), 3):  # files arrive in order of receipt
        spark.createDataFrame(ROWS[k : k + 3], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_watch_is_exactly_once_over_restarts(spark, stream, tmp_path):
    for _ in range(2):
        drain(increments.start_watch(stream, "errors", F.col("template") == "err", str(tmp_path / "hits"), str(tmp_path / "check"), availableNow=True))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "hits")).collect()) == [5, 7]


def test_increments_add_up(stream, tmp_path):
    seen = {}
    sink = lambda deltas, number: seen.update({(number, r["device"], r["template"]): r["delta"] for r in deltas.collect()})
    drain(increments.start_increments(stream, sink, str(tmp_path / "check"), availableNow=True))
    assert sum(seen.values()) == len(ROWS) and len({n for n, *_ in seen}) > 1


def run(spark, df, tmp_path, name):
    drain(df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start(str(tmp_path / name)))
    return spark.read.parquet(str(tmp_path / name)).collect()


def test_epochs_agree_with_batch(spark, stream, tmp_path):
    got = {r["event_id"]: r["boot"] for r in run(spark, increments.streaming_epochs(stream, F.col("template") == "boot"), tmp_path, "epochs")}
    assert got == {1: 1, 2: 1, 3: 0, 4: 2, 5: 2, 6: 1, 7: 1}


def test_coalescing(spark, stream, tmp_path):
    got = sorted((r["event_id"], r["held"]) for r in run(spark, increments.coalesced(stream), tmp_path, "notes"))
    assert got == [(1, 0), (3, 0), (5, 2), (6, 0)]
