"""Log files: line ends, gzip by content, duplicates, codecs, exports."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from emberline.sources import files

ENDS = {"lf": b"\n", "crlf": b"\r\n", "cr": b"\r", "none": b""}


@pytest.mark.parametrize(
    "data, wanted",
    [
        (b"", []),
        (b"a\nb", [(0, b"a", "lf"), (2, b"b", "none")]),
        (b"a\r\nb\r\n", [(0, b"a", "crlf"), (3, b"b", "crlf")]),
        (b"a\rb\r", [(0, b"a", "cr"), (2, b"b", "cr")]),
        (b"10%\r20%\rdone\n", [(0, b"10%\r20%\rdone", "lf")]),
        (b"\n\n", [(0, b"", "lf"), (1, b"", "lf")]),
    ],
)
def test_split(data, wanted):
    assert [(o, c, t) for o, c, t, *_ in files.split_lines(data)] == wanted


def test_split_loses_nothing():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\r\n\xff") for _ in range(rng.randint(0, 40)))
        rows = list(files.split_lines(data, most=7))
        assert b"".join(c + ENDS[t] for _, c, t, *_ in rows) == data
        assert all(data[o : o + len(c)] == c for o, c, *_ in rows)
        assert all(more == (k > 0 and rows[k - 1][3]) for k, (*_, more) in enumerate(rows))


def test_read_logs(spark, tmp_path):
    log = b"one\r\ntwo \xff\nthree"
    (tmp_path / "plain.log").write_bytes(log)
    (tmp_path / "packed.txt").write_bytes(gzip.compress(log))
    (tmp_path / "copy.log").write_bytes(log)
    (tmp_path / "empty.log").write_bytes(b"")
    rows = files.read_logs(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], bytes(r["bytes"]), r["terminator"]))
    wanted = [(0, b"one", "crlf"), (1, b"two \xff", "lf"), (2, b"three", "none")]
    assert {k: sorted(v) for k, v in by.items()} == {"plain.log": wanted, "packed.txt": wanted, "copy.log": wanted}
    facts = {r["path"].rsplit("/", 1)[1]: r["duplicate_of"] for r in files.file_facts(spark, str(tmp_path)).collect()}
    assert facts["plain.log"].endswith("copy.log") and facts["copy.log"] is None and facts["packed.txt"] is None


def test_codecs(spark):
    rows = [(0, 'x', '- {"dt": "t", "lvl": "target", "msg": "a \\"q\\""}'), (1, "x", "plain"), (2, "x", "- {broken}")]
    frame = spark.createDataFrame(rows, "line_no long, path string, text string").select("line_no", files.lab_runner_message(F.col("text")).alias("m"))
    assert [tuple(r["m"]) if r["m"] else None for r in frame.orderBy("line_no").collect()] == [("target", 'a "q"'), None, None]
    store = spark.createDataFrame([(k, "p", t) for k, t in enumerate(["Panic#1 Part1", "====", "<4>real", "===="])], "line_no long, path string, text string")
    assert [r["line_no"] for r in files.without_store_headers(store).orderBy("line_no").collect()] == [2, 3]


def test_export_and_import(spark, tmp_path):
    data = b"a\nb\r\nc\r\n\xfe\nlast"
    (tmp_path / "in.log").write_bytes(data)
    lines = files.read_logs(spark, str(tmp_path / "in.log"))
    files.export_session(lines, str(tmp_path / "archive"), {"session": 7})
    archive = files.import_session(spark, str(tmp_path / "archive"))
    assert gzip.decompress(archive).startswith(files.EXPORT_MAGIC)
    (tmp_path / "again").write_bytes(archive)
    again = files.read_logs(spark, str(tmp_path / "again")).orderBy("line_no").collect()
    assert b"".join(bytes(r["bytes"]) + ENDS[r["terminator"]] for r in again) == data


def test_metrics(spark):
    out = files.metrics_text(spark.createDataFrame([("d", 3, 2, 1.5)], "device string, lines long, templates long, fragmentation double")).collect()
    assert sorted(r["value"] for r in out) == ['emberline_fragmentation{device="d"} 1.5', 'emberline_lines{device="d"} 3.0', 'emberline_templates{device="d"} 2.0']


def test_metric_series_reads_hex_and_units(spark):
    from emberline.operators import values

    rows = [("d", 1, 1, 1, "0x1f"), ("d", 2, 1, 2, "12ms"), ("d", 3, 1, 3, "words"), ("d", 3, 2, 4, "1.5")]
    samples = spark.createDataFrame(rows, "device string, boot int, at long, id long, value string")
    assert {(r["boot"], r["value"]) for r in values.metric_series(samples, "last").collect()} == {(1, 31.0), (2, 12.0), (3, 1.5)}
