"""Epochs of a device's log: parted at resets, with fingerprints, runs, loops and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.asof import as_of

#: Equal fingerprints in a row that make a loop.
LOOP_RUN = 3


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """The running sum of ``value`` within keys by order, in two levels.

    Rows are summed within (keys, bucket) and buckets' totals within keys, so no
    task sorts all rows of one key. ``bucket`` must not fall along ``order``.
    """
    rows = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    summed = rows.withColumn(name, F.sum(value).over(inner)).join(totals, [*keys, "_bucket"])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def assign_epochs(log: DataFrame, is_reset: Column, bucket_ms: int = 86_400_000) -> DataFrame:
    """Adds ``boot``: the number of resets of the device so far (0 before the first)."""
    return running_total(log, ["device"], F.expr(f"at div {bucket_ms}"), ["at", "event_id"], is_reset.cast("long"), "boot")


def fingerprint(ordered: Column) -> Column:
    """32 hex digits of SHA-256 over a sequence of template texts; the order counts."""
    return F.substring(F.sha2(F.array_join(ordered, "\n"), 256), 1, 32)


def epoch_table(log: DataFrame) -> DataFrame:
    """device, seq, opened_at, last_at, closed_at, records, errors, bytes, fingerprint."""
    order = F.array_sort(F.collect_list(F.struct("at", "event_id", "template")))
    grouped = log.groupBy("device", F.col("boot").alias("seq")).agg(
        F.min("at").alias("opened_at"),
        F.max("at").alias("last_at"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("severity") <= 3).alias("errors"),
        F.sum(F.length("props")).alias("bytes"),
        order.alias("sequence"),
    )
    by_device = Window.partitionBy("device").orderBy("seq")
    return grouped.select(
        "device",
        "seq",
        "opened_at",
        "last_at",
        F.lead("opened_at").over(by_device).alias("closed_at"),
        "records",
        "errors",
        "bytes",
        fingerprint(F.col("sequence.template")).alias("fingerprint"),
    )


def _islands(epochs: DataFrame) -> DataFrame:
    by_device = Window.partitionBy("device").orderBy("seq")
    changed = F.coalesce((F.lag("fingerprint").over(by_device) != F.col("fingerprint")).cast("int"), F.lit(1))
    return epochs.withColumn("changed", changed).withColumn("island", F.sum("changed").over(by_device))


def fingerprint_runs(epochs: DataFrame) -> DataFrame:
    """Runs of equal fingerprints: device, first_seq, last_seq, run, fingerprint."""
    return (
        _islands(epochs).groupBy("device", "island")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("run"), F.first("fingerprint").alias("fingerprint"))
        .drop("island")
    )


def with_runs(epochs: DataFrame) -> DataFrame:
    """The epochs with ``run``, the length of the run of equal fingerprints that each is in, and ``stable_since``, its first epoch."""
    own = Window.partitionBy("device", "island")
    return _islands(epochs).withColumns({"run": F.count(F.lit(1)).over(own), "stable_since": F.min("seq").over(own)}).drop("changed", "island")


def fingerprint_histogram(epochs: DataFrame, last: int) -> DataFrame:
    """How often each fingerprint occurs among a device's newest epochs."""
    newest = Window.partitionBy("device").orderBy(F.desc("seq"))
    recent = epochs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last)
    return recent.groupBy("device", "fingerprint").agg(F.count(F.lit(1)).alias("n"))


def attempts(epochs: DataFrame, opened: DataFrame) -> DataFrame:
    """The epochs that are attempts to boot, with ``opened_by``: not those that a session or a mark opened, nor those without bytes.

    opened: device, seq, opened_by; epochs that it does not name opened by themselves.
    """
    joined = epochs.join(opened.select("device", "seq", "opened_by"), ["device", "seq"], "left")
    return joined.where((F.col("opened_by").isNull() | ~F.col("opened_by").isin("session", "mark")) & (F.col("bytes") > 0))


def loop_class(epochs: DataFrame, window: int = 12, marks: DataFrame | None = None) -> DataFrame:
    """device, run, distinct, crashed, kind: how the newest epochs repeat.

    ``run`` is the number of newest epochs with one fingerprint. A run of LOOP_RUN or more is ``watchdog`` if half of it has such a message,
    ``crash`` if half of it has errors, ``flapping`` with over two fingerprints in the window, ``stage_capped`` if none of it
    reached userspace, else ``stable``; a shorter one is ``unstable`` with over two, else ``none``.
    marks: device, seq, watchdog, userspace (booleans); without it no run is ``watchdog`` or ``stage_capped``.
    """
    newest = Window.partitionBy("device").orderBy(F.desc("seq"))
    recent = epochs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= window)
    first = F.first("fingerprint").over(newest)
    recent = recent.withColumn("broken", F.max((F.col("fingerprint") != first).cast("int")).over(newest))
    if marks is None:
        recent = recent.withColumns({"watchdog": F.lit(False), "userspace": F.lit(True)})
    else:
        recent = recent.join(marks.select("device", "seq", "watchdog", "userspace"), ["device", "seq"], "left")
    in_run = F.col("broken") == 0
    grouped = recent.groupBy("device").agg(
        F.count_if(in_run).alias("run"),
        F.countDistinct("fingerprint").alias("distinct"),
        F.count_if(in_run & (F.col("errors") > 0)).alias("crashed"),
        F.count_if(in_run & F.col("watchdog")).alias("barked"),
        F.count_if(in_run & F.col("userspace")).alias("finished"),
        F.count(F.lit(1)).alias("seen"),
    )
    many = F.col("distinct") > 2
    kind = (
        F.when(F.col("seen") < LOOP_RUN, "none")
        .when(F.col("run") < LOOP_RUN, F.when(many, "unstable").otherwise("none"))
        .when(F.col("barked") * 2 >= F.col("run"), "watchdog")
        .when(F.col("crashed") * 2 >= F.col("run"), "crash")
        .when(many, "flapping")
        .when(F.col("finished") == 0, "stage_capped")
        .otherwise("stable")
    )
    return grouped.select("device", "run", "distinct", "crashed", kind.alias("kind"))


def garbage_state(log: DataFrame, is_garbage: Column, is_banner: Column) -> DataFrame:
    """device, seq, spans, resolved of the epochs with garbage: resolved if a stage banner comes after the last of it."""
    place = F.struct("at", "event_id")
    grouped = log.groupBy("device", F.col("boot").alias("seq")).agg(
        F.count_if(is_garbage).alias("spans"), F.max(F.when(is_garbage, place)).alias("garbage"), F.max(F.when(is_banner, place)).alias("banner")
    )
    return grouped.where("spans > 0").select("device", "seq", "spans", F.coalesce(F.col("banner") > F.col("garbage"), F.lit(False)).alias("resolved"))


def outcomes(
    epochs: DataFrame, log: DataFrame, now: int, hung_ms: int = 30_000, booting_ms: int = 15_000, *,
    attested: DataFrame | None = None, garbage: DataFrame | None = None, prompts: DataFrame | None = None,
) -> DataFrame:
    """device, seq, outcome by the first rule that holds: no_output or unknown_capture, garbage, crashed, booted, booting, looping,
    login_wait or at_prompt, hung, ended, in_progress.

    ``attested`` (device, seq) names epochs with a live capture (None: all), ``garbage`` is of ``garbage_state``, ``prompts``
    (device, kind) has what the device's last line is a prompt of, which an epoch still open waits at.
    """
    marks = log.groupBy("device", F.col("boot").alias("seq")).agg(
        F.max((F.col("severity") <= 3).cast("int")).alias("crash"), F.max((F.col("template") == "purchase").cast("int")).alias("reached")
    )
    joined = with_runs(epochs).join(marks, ["device", "seq"], "left")
    live, dirty, kind = F.lit(True), F.lit(False), F.lit(None).cast("string")
    if attested is not None:
        joined, live = joined.join(attested.select("device", "seq", F.lit(True).alias("live")).distinct(), ["device", "seq"], "left"), F.col("live").isNotNull()
    if garbage is not None:
        joined, dirty = joined.join(garbage.select("device", "seq", "resolved"), ["device", "seq"], "left"), ~F.col("resolved")
    if prompts is not None:
        joined, kind = joined.join(prompts.select("device", F.col("kind").alias("prompt")), "device", "left"), F.col("prompt")
    is_open, idle = F.col("closed_at").isNull(), F.lit(now) - F.col("last_at")
    outcome = (
        F.when(F.col("bytes") == 0, F.when(live, "no_output").otherwise("unknown_capture"))
        .when(dirty, "garbage")
        .when(F.col("crash") == 1, "crashed")
        .when(F.col("reached") == 1, "booted")
        .when(is_open & (idle < booting_ms), "booting")
        .when(F.col("run") >= LOOP_RUN, "looping")
        .when(is_open & kind.isNotNull(), F.when(kind == "login", "login_wait").otherwise("at_prompt"))
        .when(is_open & (idle >= hung_ms), "hung")
        .when(~is_open, "ended")
        .otherwise("in_progress")
    )
    return joined.select("device", "seq", outcome.alias("outcome"))


def previous_epoch(epochs: DataFrame) -> DataFrame:
    """Each epoch with the one before it on its device."""
    by_device = Window.partitionBy("device").orderBy("seq")
    return epochs.select("device", "seq", F.lag("seq").over(by_device).alias("previous_seq"), F.lag("fingerprint").over(by_device).alias("previous_fingerprint"))


def epoch_at(epochs: DataFrame, points: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """points (point_id, device, at) with the latest epoch open at that time (as of); none: null.

    Epochs are ordered and don't overlap, so it is the newest opening at or before the point, checked against its end.
    """
    marks = epochs.select("device", F.col("opened_at").alias("at"), F.col("seq").alias("tie"), F.struct("seq", "closed_at").alias("value"))
    found = as_of(marks, points.select(F.col("point_id").cast("long"), "device", "at"), ["device"], "at", bucket_ms, "epoch")
    covered = F.col("epoch.closed_at").isNull() | (F.col("at") <= F.col("epoch.closed_at"))
    return found.select("point_id", "device", "at", F.when(covered, F.col("epoch.seq")).alias("seq"))


def opened_positions(log: DataFrame) -> DataFrame:
    """device, seq, opened_offset, bytes: the least position in each epoch, and its size."""
    return log.groupBy("device", F.col("boot").alias("seq")).agg(F.min("event_id").alias("opened_offset"), F.sum(F.length("props")).alias("bytes"))


def epoch_covering(opened: DataFrame, points: DataFrame, bucket: int = 100_000) -> DataFrame:
    """points (point_id, device, position) with ``seq``: the epoch that isn't empty and opened last at or before the position; none: null."""
    marks = opened.where("bytes > 0 and opened_offset is not null").select("device", F.col("opened_offset").alias("position"), F.col("seq").alias("tie"), F.col("seq").alias("value"))
    return as_of(marks, points.select("point_id", "device", "position"), ["device"], "position", bucket, "seq")


def siblings(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """device, seq, sibling_device, sibling_seq: the other epochs of the group of each asked one; groups: device, seq, group_id."""
    own = asked.join(groups.where("group_id is not null"), ["device", "seq"])
    others = groups.select("group_id", F.col("device").alias("sibling_device"), F.col("seq").alias("sibling_seq"))
    met = own.join(others, "group_id").where((F.col("device") != F.col("sibling_device")) | (F.col("seq") != F.col("sibling_seq")))
    return met.select("device", "seq", "sibling_device", "sibling_seq")


def protected_positions(opened: DataFrame, baselines: DataFrame) -> DataFrame:
    """device, protected: the least position of each device's baseline epochs; nothing from it on may be pruned."""
    return opened.join(baselines, ["device", "seq"], "left_semi").groupBy("device").agg(F.min("opened_offset").alias("protected"))


def default_start(log: DataFrame, opened: DataFrame, grace: int, lookback: int) -> DataFrame:
    """device, start, why: where following starts: ``grace`` before the newest epoch, but at most ``lookback`` before the head, or else at the head."""
    head = log.groupBy("device").agg((F.max("event_id") + 1).alias("head"))
    newest = opened.groupBy("device").agg(F.max_by("opened_offset", "seq").alias("opened_offset"))
    joined = head.join(newest, "device", "left")
    wanted = F.when(F.col("opened_offset").isNotNull(), F.greatest(F.col("opened_offset") - grace, F.lit(0)))
    floor = F.greatest(F.col("head") - lookback, F.lit(0))
    start = F.when(wanted.isNull(), F.col("head")).otherwise(F.greatest(wanted, floor))
    why = F.when(wanted.isNull(), "head").when(wanted >= floor, "epoch").otherwise("tail")
    return joined.select("device", start.alias("start"), why.alias("why"))


def stage_reach(log: DataFrame, epochs: DataFrame) -> DataFrame:
    """device, seq, stage, after_ms: when each stage (template) is first entered, from the epoch's opening."""
    first = log.groupBy("device", F.col("boot").alias("seq"), F.col("template").alias("stage")).agg(F.min("at").alias("entered_at"))
    return first.join(epochs.select("device", "seq", "opened_at"), ["device", "seq"]).select(
        "device", "seq", "stage", F.greatest(F.col("entered_at") - F.col("opened_at"), F.lit(0)).alias("after_ms")
    )


def stage_durations(log: DataFrame, epochs: DataFrame) -> DataFrame:
    """device, seq, stage, entered_at, duration_ms: until the next stage of the epoch, or else its end, at least 0; open: null."""
    first = log.groupBy("device", F.col("boot").alias("seq"), F.col("template").alias("stage")).agg(F.min("at").alias("entered_at"))
    order = Window.partitionBy("device", "seq").orderBy("entered_at", "stage")
    joined = first.withColumn("next_at", F.lead("entered_at").over(order)).join(epochs.select("device", "seq", "closed_at"), ["device", "seq"])
    until = F.coalesce("next_at", "closed_at")
    return joined.select("device", "seq", "stage", "entered_at", F.greatest(until - F.col("entered_at"), F.when(until.isNotNull(), 0)).alias("duration_ms"))


def stage_timings(durations: DataFrame) -> DataFrame:
    """Per device and stage: samples, min, max, mean (rounded) and trend.

    The trend is the least-squares slope over epochs, two places; null below three samples or for equal epochs.
    """
    known = durations.where("duration_ms is not null")
    return known.groupBy("device", "stage").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.round(F.avg(F.col("duration_ms").cast("double"))).cast("long").alias("mean_ms"),
        F.when((F.count(F.lit(1)) >= 3) & (F.min("seq") != F.max("seq")), F.round(F.regr_slope(F.col("duration_ms").cast("double"), F.col("seq").cast("double")), 2)).alias("trend"),
    )


def claim_ranges(log: DataFrame, claims: DataFrame, bucket: int = 100_000) -> DataFrame:
    """The log with ``claimed``: the newest claim (device, from_event, claim) at or before each record, or null.

    An epoch that was opened by an action claims all records from its own position on.
    """
    marks = claims.select("device", F.col("from_event").alias("event_id"), F.col("claim").alias("tie"), F.col("claim").alias("value"))
    return as_of(marks, log, ["device"], "event_id", bucket, "claimed")


def idle(log: DataFrame, now: int) -> DataFrame:
    """device, idle_ms: since each device's last record, at least 0."""
    return log.groupBy("device").agg(F.greatest(F.lit(now) - F.max("at"), F.lit(0).cast("long")).alias("idle_ms"))


def prompts_reached(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """device, kind: what kind of prompt each device's last line that isn't blank is, by the first pattern that fits; none: null."""
    last = lines.where(F.trim("text") != "").groupBy("device").agg(F.max_by("text", F.struct("session_id", "line_no")).alias("text"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    return last.select("device", kind.alias("kind"))
