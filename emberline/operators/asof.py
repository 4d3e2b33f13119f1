"""As-of joins in two levels: within buckets of positions, then over the buckets' newest marks, so no task sorts all rows of one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(marks: DataFrame, points: DataFrame, keys: list[str], position: str, bucket: int, name: str) -> DataFrame:
    """The points with ``name``: the value of the newest mark at or before each one's position, among marks of equal keys; none: null.

    marks: keys, position, tie (orders marks at one position) and value; marks without a value are left out.
    """
    own = marks.where("value is not null").select(*keys, position, F.lit(0).alias("_kind"), F.col("tie").alias("_tie"), F.col("value").alias("_mark"))
    both = own.unionByName(points.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_bucket", F.expr(f"{position} div {bucket}"))
    parts = [*keys, "_bucket"]
    newest = both.groupBy(*parts).agg(F.max_by("_mark", F.when(F.col("_kind") == 0, F.struct(position, "_tie"))).alias("_newest"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*(F.col(c).alias(f"_of_{c}") for c in parts), F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy(*parts).orderBy(position, "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_mark", ignorenulls=True).over(within)).where("_kind = 1")
    met = found.join(carried, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in parts)))
    return met.select(*points.columns, F.coalesce("_own", "_carried").alias(name))
