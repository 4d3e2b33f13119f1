"""Connected components of a link table, by hooking and pointer jumping in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import Scratch


def components(ids: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc_id, component: the smallest doc_id reachable over links (a, b); ids without links are their own.

    Every round each label takes the smallest label that a link joins it to, and
    labels then jump to their labels' labels until they stand still. Each round at least
    halves the number of labels that still have links to others, so rounds go with the logarithm of the longest chain. A round's tables
    go when the next labels are stored.
    """
    held = f"{name}-start"
    labels = scratch.write(ids.select("doc_id", F.col("doc_id").alias("component")), held)
    open_links = links.select("a", "b").where("a != b").distinct()
    turn = 0
    while True:
        # Links between labels, both ways.
        a = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("x"))
        b = labels.select(F.col("doc_id").alias("b"), F.col("component").alias("y"))
        between = open_links.join(a, "a").join(b, "b").where("x != y").select("x", "y").distinct()
        both = scratch.write(between.union(between.select("y", "x")).distinct(), f"{name}-between{turn}")
        if both.isEmpty():
            scratch.drop(f"{name}-between{turn}")
            return labels
        hooks = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        hops = 0
        while True:  # a hook leads to a smaller label, so chains end
            next_ = hooks.alias("h").join(hooks.select(F.col("x").alias("mid"), F.col("to").alias("end")), F.col("to") == F.col("mid"), "left")
            jumped = scratch.write(next_.select("x", F.coalesce("end", "to").alias("to"), (F.coalesce("end", "to") != F.col("to")).alias("moved")), f"{name}-hooks{turn}-{hops}")
            hooks = jumped.select("x", "to")
            hops += 1
            if jumped.where("moved").isEmpty():
                break
        renamed = labels.join(hooks, labels["component"] == hooks["x"], "left").select("doc_id", F.coalesce("to", "component").alias("component"))
        labels = scratch.write(renamed, f"{name}-labels{turn}")
        scratch.drop(held, f"{name}-between{turn}", *(f"{name}-hooks{turn}-{k}" for k in range(hops)))
        held = f"{name}-labels{turn}"
        turn += 1
