"""From log files to tables: lines, records, templates, occurrences, epochs, versions.

Raw lines are written first and never changed; every other table can be made
again from them. Tables are Parquet, parted by device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as texts
from emberline.operators import framing, mining
from emberline.sources import files
from emberline.sources.profiles import PROFILES


def raw_lines(spark: SparkSession, path: str, device: Column | None = None) -> DataFrame:
    """Lines of all files: device (by default the file's name), session_id (the file), line_no, offset, bytes, terminator, truncated, continuation."""
    lines = files.read_logs(spark, path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)
    return lines.select((device if device is not None else name).alias("device"), F.col("path").alias("session_id"), "line_no", "offset", "bytes", "terminator", "truncated", "continuation")


def ingest(spark: SparkSession, path: str, out: str, device: Column | None = None) -> dict[str, DataFrame]:
    """Reads log files and writes all tables below ``out``; gives the tables as read back."""
    raw_lines(spark, path, device).write.partitionBy("device").parquet(f"{out}/raw_lines")
    return rebuild(spark, out)


def rebuild(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Makes all derived tables from the raw lines again."""

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy("device").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    raw = spark.read.parquet(f"{out}/raw_lines")
    lines = raw.select("device", "session_id", F.col("line_no").cast("long").alias("line_no"), texts.lossy_text(F.col("bytes")).alias("text"))
    keyed = lines.select("device", "session_id", "line_no", texts.mine_key(F.col("text")).alias("text"), texts.severity(F.col("text")).alias("severity"))

    # A record goes by its first line: device and key, and severity unless a trigger says it.
    framed = framing.Framed(lines, PROFILES)
    records = framed.records().withColumnRenamed("severity", "told").join(keyed.withColumnRenamed("line_no", "first_line"), ["session_id", "first_line"])
    records = records.withColumn("severity", F.coalesce("told", "severity")).drop("told")
    stages = framed.stages().join(lines.select("session_id", "device").distinct(), "session_id")
    assigned, templates = mining.mine(records.where("kind != 'garbage'").select("device", "session_id", F.col("first_line").alias("line_no"), "text"), ["session_id", "line_no"])
    ids = assigned.select("session_id", F.col("line_no").alias("first_line"), "template_id")
    records = stored(records.drop("text").join(ids, ["session_id", "first_line"], "left"), "records")
    occurrences = records.where("template_id is not null").groupBy("device", "template_id", "session_id").agg(F.count(F.lit(1)).alias("count"), F.min("severity").alias("severity"))
    versions = keyed.select("device", "session_id", "line_no", texts.version(F.col("text")).alias("v")).where("v is not null").select("device", "session_id", "line_no", "v.*")
    return {
        "raw_lines": raw,
        "records": records,
        "templates": stored(templates, "templates"),
        "occurrences": stored(occurrences, "occurrences"),
        "stages": stored(stages, "stages"),
        "versions": stored(versions, "versions"),
    }

