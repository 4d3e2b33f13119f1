"""Files read by byte ranges give the rows of files that are read whole."""

import random

import pytest

from emberline.sources import files, ranges


@pytest.fixture
def logs(tmp_path):
    rng = random.Random(1)
    made = {
        "long.log": b"".join(bytes(rng.choice(b"abc \xff\xc3") for _ in range(rng.choice([0, 1, 5, 40, 200]))) + rng.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(3000)),
        "open.log": b"one\ntwo\r\nthree",
        "returned.log": b"one\ntwo\r",
        "marked.log": b"\xef\xbb\xbfone\ntwo\n",
        "marked-open.log": b"\xef\xbb\xbfone\ntwo",
        "bars.log": b"10%\r20%\rdone\nnext\n",
        "wide.log": b"a\n" + b"x" * 5000 + b"\r\n" + b"y" * 3000 + b"\n" + b"z" * 1000,
        "blank.log": b"\n\n\n",
        "one.log": b"x\n",
        "empty.log": b"",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, made


@pytest.mark.parametrize("range_bytes, most", [("128m", 1 << 20), ("4k", 1 << 20), ("700b", 1000), ("4k", 1000)])
def test_as_whole_files(spark, logs, range_bytes, most):
    folder, made = logs
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, range_bytes)
        got = ranges.read_large_logs(spark, str(folder), most)
        tasks = spark.read.text(str(folder / "long.log")).rdd.getNumPartitions()
        rows = sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["offset"], bytes(r["bytes"]), r["terminator"], r["truncated"], r["continuation"]) for r in got.collect())
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    wanted = sorted((name, k, *row) for name, data in made.items() for k, row in enumerate(files.split_lines(data, most)))
    assert rows == wanted
    assert tasks >= {"128m": 1, "4k": 30, "700b": 100}[range_bytes]


def test_paths_are_those_of_whole_files(spark, logs):
    folder, _ = logs
    paths = lambda df: {r["path"] for r in df.select("path").distinct().collect()}
    assert paths(ranges.read_large_logs(spark, str(folder / "one.log"))) == paths(files.read_logs(spark, str(folder / "one.log")))
