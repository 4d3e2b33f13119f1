"""Log files to tables and back."""

import gzip

from pyspark.sql import functions as F

from emberline.plans.ingest import ingest, rebuild
from tests.test_framing import LINUX


def test_ingest_and_rebuild(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    (source / "board1.log").write_bytes("\r\n".join(LINUX).encode() + b"\xff\n")
    (source / "board2.log.gz").write_bytes(gzip.compress("\n".join(LINUX * 3).encode()))
    tables = ingest(spark, str(source), str(tmp_path / "out"))
    n = {r["device"]: r["n"] for r in tables["raw_lines"].groupBy("device").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"board1": len(LINUX), "board2": 3 * len(LINUX)}
    records = tables["records"].groupBy("device").agg(F.sum("n_lines").alias("lines"), F.count_if(F.col("kind") == "crash").alias("crashes"))
    assert {r["device"]: (r["lines"], r["crashes"]) for r in records.collect()} == {"board1": (len(LINUX), 2), "board2": (3 * len(LINUX), 6)}
    assert tables["occurrences"].agg(F.sum("count")).first()[0] == tables["records"].where("template_id is not null").count()
    assert tables["templates"].agg(F.sum("count")).first()[0] == tables["records"].where("template_id is not null").count()
    assert {(r["component"], r["version"]) for r in tables["versions"].collect()} == {("Linux version", "6.1.0"), ("U-Boot", "2024.01")}
    before = sorted(map(str, tables["templates"].collect()))
    assert sorted(map(str, rebuild(spark, str(tmp_path / "out"))["templates"].collect())) == before
