"""Follows end at the first rule that holds, whatever the batches."""

import random
import time

from pyspark.sql import functions as F

from emberline.streaming.follow import Until, until

SCHEMA = "device string, event_id long, at long, template string, stamp timestamp"


def write(spark, path, rows):
    frame = spark.createDataFrame(rows, "device string, event_id long, at long, template string")
    frame.withColumn("stamp", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(path)


def log(seed):
    rng = random.Random(seed)
    rows, at = [], {f"d{d}": 0 for d in range(8)}
    for k in range(400):
        device = f"d{rng.randrange(8)}"
        at[device] += rng.choice([10, 10, 10, 900, 1200 if k > 60 else 20])
        rows.append((device, k, at[device], rng.choice(["boot", "x", "y", "z", "reset", "login:", "fail"] if k > 90 else ["x", "y"])))
    return rows


def by_hand(rows, rules):
    """rules: (label, set of templates, new, quiet)."""
    found = {}
    for device in {r[0] for r in rows}:
        last, seen = None, set()
        for _, k, at, template in sorted(r for r in rows if r[0] == device):
            quiet = next((label for label, _, _, ms in rules if ms and last and at - last[1] >= ms), None)
            if quiet:
                found[device] = (quiet, last[0], last[1] + next(ms for *_, ms in rules if ms))
                break
            last = (k, at)
            held = next((label for label, some, new, _ in rules if template in some or (new and template not in seen)), None)
            seen.add(template)
            if held:
                found[device] = (held, k, at)
                break
    return found


def run(spark, tmp_path, df, **trigger):
    query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(**(trigger or {"availableNow": True})).start(str(tmp_path / "out"))
    if not trigger:
        query.awaitTermination(120)
        assert query.exception() is None
    return query


def found(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.schema("device string, rule string, event_id long, at long").parquet(str(tmp_path / "out")).collect())


def test_first_of_several_rules_in_batches(spark, tmp_path):
    rows, path = log(3), str(tmp_path / "in")
    rng = random.Random(4)
    for lo in range(0, 400, 150):
        part = rows[lo : lo + 150] + rows[max(0, lo - 5) : lo]  # some again
        write(spark, path, rng.sample(part, len(part)))
    is_ = lambda *names: F.col("template").isin(*names)
    rules = [Until("reset", is_("reset")), Until("pattern", F.col("template").rlike("^(fail|reset)$")), Until("stage:boot", is_("boot")), Until("prompt", F.col("template").rlike(":$"))]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    run(spark, tmp_path, until(stream, rules))
    wanted = by_hand(rows, [("reset", {"reset"}, False, None), ("pattern", {"fail", "reset"}, False, None), ("stage:boot", {"boot"}, False, None), ("prompt", {"login:"}, False, None)])
    assert {r[0]: r[1:] for r in found(spark, tmp_path)} == wanted and len(found(spark, tmp_path)) == len(wanted) == 8
    run(spark, tmp_path, until(stream, rules))  # a restart adds nothing
    assert len(found(spark, tmp_path)) == 8


def test_silence_and_what_is_new(spark, tmp_path):
    rows, path = log(5), str(tmp_path / "in")
    for lo in range(0, 400, 200):
        write(spark, path, rows[lo : lo + 200])
    write(spark, path, [("late", 1000, 10_000_000, "x")])
    rules = [Until("quiet", quiet_ms=1000), Until("new", new=True)]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("stamp", "1 hour")
    run(spark, tmp_path, until(stream.where("device != 'd0'"), rules, event_time="stamp"))
    wanted = by_hand([r for r in rows if r[0] != "d0"], [("quiet", set(), False, 1000), ("new", set(), True, None)])
    assert {r[0]: r[1:] for r in found(spark, tmp_path) if r[0] != "late"} == wanted


def test_silence_at_the_end_by_the_clock(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", 1, 0, "x"), ("a", 2, 100, "y"), ("b", 1, 0, "x"), ("b", 2, 100, "fail")])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    query = run(spark, tmp_path, until(stream, [Until("fail", F.col("template") == "fail"), Until("quiet", quiet_ms=2000)]), processingTime="0 seconds")
    end = time.time() + 60
    while time.time() < end and query.exception() is None and len(query.recentProgress) < 2:
        time.sleep(0.2)
    while time.time() < end and len(found(spark, tmp_path)) < 2:
        time.sleep(0.5)
    query.stop()
    assert found(spark, tmp_path) == [("a", "quiet", 2, 2100), ("b", "fail", 2, 100)]
