"""Logical tables over the driver's files.

=============  ==============================================================
``lines``      documents, a row a line: device=source, session=doc_id
``log``        events as log records: device=user_id, template=event_type
``epochs``     ``log`` parted at ``signup`` records, a row an epoch
``records``    conversations: a record a turn, lines of its text
=============  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.epochs import assign_epochs, epoch_table

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Unix milliseconds, rounded down, of a timestamp without time zone."""
    seconds = f"cast(cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6))"
    return F.expr(f"cast(floor({seconds} * 1000) as bigint)")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("device"),
        F.col("doc_id").alias("session_id"),
        F.col("lang").alias("stage"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "text"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 5).otherwise(6)
    return table(spark, sf_dir, "events").select(
        "event_id",
        millis("ts").alias("at"),
        F.col("user_id").alias("device"),
        F.col("event_type").alias("template"),
        severity.alias("severity"),
        "value",
        "props",
    )


def log_with_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_epochs(log(spark, sf_dir), F.col("template") == "signup", bucket_ms=DAY_MS)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epoch_table(log_with_epochs(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("record_no"),
        F.col("role").alias("kind"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"),
    )
