"""Comparing sessions, epochs and builds; what is expected and missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer difference of two count tables: keys, count_a, count_b, change (new, gone, shifted, same)."""
    both = a.select(*keys, F.col("count").alias("count_a")).join(b.select(*keys, F.col("count").alias("count_b")), keys, "full")
    change = (
        F.when(F.col("count_a").isNull(), "new")
        .when(F.col("count_b").isNull(), "gone")
        .when(F.col("count_a") != F.col("count_b"), "shifted")
        .otherwise("same")
    )
    return both.select(*keys, F.coalesce("count_a", F.lit(0)).alias("count_a"), F.coalesce("count_b", F.lit(0)).alias("count_b"), change.alias("change"))


def diff_epochs(rollup: DataFrame, a: int, b: int) -> DataFrame:
    """Templates of epoch b against those of epoch a, per device that has both."""
    counts = lambda n: rollup.where(F.col("boot") == n).select("device", "template", "count")
    have = counts(a).select("device").distinct().join(counts(b).select("device").distinct(), "device")
    return diff_counts(counts(a).join(have, "device", "left_semi"), counts(b).join(have, "device", "left_semi"), ["device", "template"])


def diff_builds(rollup: DataFrame, builds: DataFrame, a: str, b: str) -> DataFrame:
    """Templates of all epochs of build b against those of build a; builds has device, boot, build."""
    joined = rollup.join(builds, ["device", "boot"])
    counts = lambda n: joined.where(F.col("build") == n).groupBy("template").agg(F.sum("count").alias("count"))
    return diff_counts(counts(a), counts(b), ["template"])


def diff_stages(reach: DataFrame, a: int, b: int) -> DataFrame:
    """device, stage, reached_a, reached_b, delta_ms, only_in: when each stage is first entered in epoch b against epoch a, of devices that have both.

    reach is of ``epochs.stage_reach``; a stage of one epoch only has no delta.
    """
    of = lambda n, name: reach.where(F.col("seq") == n).select("device", "stage", F.col("after_ms").alias(name))
    have = of(a, "x").select("device").distinct().join(of(b, "x").select("device").distinct(), "device")
    both = of(a, "reached_a").join(of(b, "reached_b"), ["device", "stage"], "full").join(have, "device", "left_semi")
    only = F.when(F.col("reached_b").isNull(), "a").when(F.col("reached_a").isNull(), "b")
    return both.select("device", "stage", "reached_a", "reached_b", (F.col("reached_b") - F.col("reached_a")).alias("delta_ms"), only.alias("only_in"))


def epochs_of_image(epochs: DataFrame, images: DataFrame, reference: str) -> DataFrame:
    """device, seq, image_id of the epochs that ran an image: by its name, hash or revision, or by how the revision begins, whatever its case.

    epochs: device, seq, image_id; images: image_id, name, git_sha, image_hash. An image without a revision has none to begin with it.
    """
    exact = (F.col("name") == reference) | (F.col("git_sha") == reference) | (F.col("image_hash") == reference)
    named = images.where(exact | F.startswith(F.lower("git_sha"), F.lit(reference.lower())))
    return epochs.join(named.select("image_id"), "image_id", "left_semi").select("device", "seq", "image_id")


def restrict_to_common_stages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a without a stage or of a stage that b has too; all rows if they share none."""
    common = a.where("stage is not null").select("stage").distinct().join(b.select("stage").distinct(), "stage", "left_semi")
    shared = common.agg(F.count(F.lit(1)).alias("n_common"))  # one row
    marked = a.join(F.broadcast(common.withColumn("is_common", F.lit(True))), "stage", "left").crossJoin(F.broadcast(shared))
    return marked.where("n_common = 0 or stage is null or is_common").select(*a.columns)


def learn_expectations(rollup: DataFrame, epochs: DataFrame, min_epochs: int) -> DataFrame:
    """device, template, seen_in, of, median_ms: in how many reference epochs a template is, and the upper median of its first offset."""
    reference = epochs.where("closed_at is not null").select("device", F.col("seq").alias("boot"), "opened_at")
    total = reference.groupBy("device").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= min_epochs)
    offsets = rollup.join(reference, ["device", "boot"]).select("device", "template", F.greatest(F.col("first_ts") - F.col("opened_at"), F.lit(0)).alias("offset"))
    learned = offsets.groupBy("device", "template").agg(F.count(F.lit(1)).alias("seen_in"), F.array_sort(F.collect_list("offset")).alias("offsets"))
    return learned.join(total, "device").select("device", "template", "seen_in", "of", F.expr("element_at(offsets, cast(size(offsets) div 2 as int) + 1)").alias("median_ms"))


def missing_in_epoch(expected: DataFrame, rollup: DataFrame, epochs: DataFrame, min_reliability: float = 0.9, late_factor: float = 3.0) -> DataFrame:
    """device, template, state for every device's newest epoch: missing, flaky (expected rarely) or late."""
    newest = epochs.groupBy("device").agg(F.max("seq").alias("boot"), F.max_by("opened_at", "seq").alias("opened_at"))
    seen = rollup.join(newest, ["device", "boot"]).select("device", "template", (F.col("first_ts") - F.col("opened_at")).alias("actual_ms"))
    joined = expected.join(newest.select("device"), "device", "left_semi").join(seen, ["device", "template"], "left")
    reliability = F.col("seen_in").cast("double") / F.col("of")
    state = (
        F.when(F.col("actual_ms").isNull(), F.when(reliability >= min_reliability, "missing").otherwise("flaky"))
        .when((F.col("median_ms") > 0) & (F.col("actual_ms") > F.col("median_ms") * late_factor), "late")
    )
    return joined.withColumn("state", state).where("state is not null").select("device", "template", "state", F.round(reliability, 4).alias("reliability"))
