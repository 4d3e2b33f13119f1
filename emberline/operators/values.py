"""Values in template slots: numbers, summaries and series over epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number out of a token: closing marks are trimmed, hex and a unit at the end are read; null for dotted versions and words."""
    plain = F.regexp_replace(F.trim(text), r"^[\"'(\[]+|[,;:)\]\"']+$", "")
    is_hex = plain.rlike(r"^[+-]?0[xX][0-9a-fA-F]{1,15}$")
    digits = F.regexp_extract(plain, r"^[+-]?0[xX]([0-9a-fA-F]{1,15})$", 1)
    sign = F.when(F.startswith(plain, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    decimal = F.regexp_extract(plain, r"^([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:[a-zA-Z%/]*)$", 1)
    return F.when(is_hex, sign * F.conv(digits, 16, 10).cast("double")).otherwise(F.when(decimal != "", decimal.cast("double")))


def slot_summary(samples: DataFrame, top: int = 10) -> DataFrame:
    """template, slot, n, distinct, top (value, n by count, then value), and min, max, mean, first, last if all values are numbers.

    samples: template, slot, at, id, value.
    """
    valued = samples.withColumn("number", number(F.col("value")))
    counted = valued.groupBy("template", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("template", "slot").orderBy(F.desc("n"), "value")
    best = counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= top)
    best = best.groupBy("template", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("ranked"))
    order = F.struct("at", "id")
    numeric = lambda c: F.when(F.count("number") == F.count(F.lit(1)), c)
    whole = valued.groupBy("template", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("value").alias("distinct"),
        numeric(F.min("number")).alias("min"),
        numeric(F.max("number")).alias("max"),
        numeric(F.round(F.avg("number"), 2)).alias("mean"),
        numeric(F.min_by("number", order)).alias("first"),
        numeric(F.max_by("number", order)).alias("last"),
    )
    text = F.array_join(F.transform("ranked", lambda r: F.concat_ws("=", r["value"], r["n"].cast("string"))), ",")
    return whole.join(best, ["template", "slot"]).withColumn("top", text).drop("ranked")


def metric_series(samples: DataFrame, how: str) -> DataFrame:
    """device, boot, value: one number an epoch, by last, first, min or max over all its samples that are numbers (hex and units too)."""
    order = F.struct("at", "id")
    value = {"last": F.max_by("number", order), "first": F.min_by("number", order), "min": F.min("number"), "max": F.max("number")}[how]
    numbers = samples.withColumn("number", number(F.col("value").cast("string"))).where("number is not null")
    return numbers.groupBy("device", "boot").agg(value.alias("value"))


def series_stats(series: DataFrame) -> DataFrame:
    """device, n, min, max, mean (two places), last of a metric series."""
    return series.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 2).alias("mean"), F.max_by("value", "boot").alias("last")
    )
