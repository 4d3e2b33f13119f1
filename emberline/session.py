"""Where a job keeps tables between its steps, and how large a broadcast may be."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few plain columns that may be broadcast (about 40 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows that Python gets at a time while a table is stored: texts are long.
BATCH_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the one set on the context; on one machine (local mode) a new one where neither is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        folder = set_.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder. They cut lineage and outlive lost executors.

    A table goes when ``drop`` or ``clear`` is called: as soon as a later table holds what was made of it. What the
    job's result still reads stays until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        with batch_rows(self.spark, BATCH_ROWS):
            df.write.parquet(self.path(table))
        self.tables.append(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.tables.remove(table)

    def clear(self, *keep: str) -> None:
        """Drops all tables but these."""
        self.drop(*[t for t in self.tables if t not in keep])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if it has at most ``limit`` rows (they are counted)."""
    return F.broadcast(df) if df.count() <= limit else df


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block, actions hand Python that many rows at a time: for long texts, whose batches would be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_heap(spark: SparkSession) -> None:
    """Has executors and the driver collect their garbage, so that heap which earlier joins and sorts have grown goes back to the machine.

    Python workers stand beside the heap under one limit of memory; a job calls this before a step that is mostly theirs. It costs a second, and does
    nothing to results; an executor that no task reaches keeps its heap.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    collected = spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') as done")
    collected.write.format("noop").mode("overwrite").save()
    release_driver(spark)


def release_driver(spark: SparkSession) -> None:
    """Has the driver give back what the plans of earlier jobs have held, their shuffles' files too: a job of many steps calls this between them."""
    for _ in range(2):  # what the first collection frees holds more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever the working folder."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
