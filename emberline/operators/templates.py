"""Templates and their occurrences: table of contents, timelines, noise, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WILDCARD = "<*>"
#: Records that a burst rate needs.
BURST_SAMPLES = 5
ORDERS = {
    "count": [F.desc, "count"],
    "first_seen": [F.asc, "first_ts"],
    "last_seen": [F.desc, "last_ts"],
    "severity": [F.asc, "severity"],
}


def occurrences(log: DataFrame) -> DataFrame:
    """The rollup: device, template, boot, count, first_ts, last_ts, severity."""
    return log.groupBy("device", "template", "boot").agg(
        F.count(F.lit(1)).alias("count"), F.min("at").alias("first_ts"), F.max("at").alias("last_ts"), F.min("severity").alias("severity")
    )


def table_of_contents(
    rollup: DataFrame,
    *,
    device: int | None = None,
    boot: int | None = None,
    min_count: int | None = None,
    min_severity: int | None = None,
    new_only: bool = False,
    not_in: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    only_verdict: list[str] | None = None,
    hide_verdict: list[str] | None = None,
    order: str = "count",
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """template, count, first_ts, last_ts, severity (and verdict): what a log holds, by ``order``, ties by template.

    ``boot`` scopes counts to one epoch number; ``new_only`` keeps templates first seen in that epoch, and
    without one keeps none; ``not_in`` (a template column) takes away a baseline's templates; smaller severities are worse.
    """
    rows = rollup
    if device is not None:
        rows = rows.where(F.col("device") == device)
    if new_only:
        born = rows.groupBy("device", "template").agg(F.min("boot").alias("_born"))
        rows = rows.join(born, ["device", "template"]).where(F.col("_born") == (F.lit(boot) if boot is not None else F.lit(None).cast("long"))).drop("_born")
    if boot is not None:
        rows = rows.where(F.col("boot") == boot)
    toc = rows.groupBy("template").agg(
        F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("severity").alias("severity")
    )
    if min_severity is not None:
        toc = toc.where(F.col("severity") <= min_severity)
    if min_count is not None:
        toc = toc.where(F.col("count") >= min_count)
    if not_in is not None:
        toc = toc.join(not_in.select("template").distinct(), "template", "left_anti")
    if verdicts is not None:
        toc = toc.join(verdicts.select("template", "verdict"), "template", "left")
        if only_verdict:
            toc = toc.where(F.col("verdict").isin(only_verdict))
        if hide_verdict:
            toc = toc.where(F.col("verdict").isNull() | ~F.col("verdict").isin(hide_verdict))
    if limit is not None:
        direction, column = ORDERS[order]
        toc = toc.orderBy(direction(column), F.asc("template"))
        toc = (toc.offset(offset) if offset else toc).limit(limit)
    return toc


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with ``capped`` (more follow) and ``next_offset`` (null at the end); one row more than the page is asked for to tell."""
    probe = (rows.orderBy(*order).offset(offset) if offset else rows.orderBy(*order)).limit(limit + 1)
    whole = Window.orderBy(*order)  # over a page's rows
    seen = probe.withColumns({"_place": F.row_number().over(whole), "capped": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit})
    return seen.where(F.col("_place") <= limit).withColumn("next_offset", F.when(F.col("capped"), F.lit(offset + limit))).drop("_place")


def capped_lists(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """key, its first ``most`` different items in order, joined by commas, and ``omitted``: how many more there are."""
    own = rows.groupBy(key, item).agg(F.count(F.lit(1)).alias("_n"))
    ranked = own.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(item)))
    grouped = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_place") <= most, F.col(item)))).alias("shown"), F.count_if(F.col("_place") > most).alias("omitted"))
    return grouped.select(key, F.array_join("shown", ",").alias("shown"), "omitted")


def timeline(log: DataFrame, template: str, buckets: int) -> DataFrame:
    """bucket, label, n: occurrences of a template over its own span, empty buckets included."""
    own = log.where(F.col("template") == template)
    span = own.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    place = F.least(F.expr(f"((at - lo) * {buckets}) div greatest(hi - lo, 1)"), F.lit(buckets - 1))
    counted = own.crossJoin(F.broadcast(span)).groupBy(place.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # span is one row
    frame = span.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    return frame.join(counted, "bucket", "left").select("bucket", F.expr(f"lo + (hi - lo) * bucket div {buckets}").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def noise(log: DataFrame, since: int, until: int) -> DataFrame:
    """device, template, n, per_min, burst_per_min, share, approximate: rates of the rollup within a window.

    A template whose first record is before the window has its count scaled by the part of its span inside.
    The burst rate is over the template's own span; fewer than BURST_SAMPLES records have none.
    """
    rollup = log.groupBy("device", "template").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first_ts"), F.max("at").alias("last_ts")).where(F.col("last_ts") >= since)
    span = (F.col("last_ts") - F.col("first_ts")).cast("double")
    cut = (F.col("first_ts") < since) & (span > 0)
    n = F.when(cut, F.round(F.col("count") * (F.col("last_ts") - F.lit(since)).cast("double") / span).cast("long")).otherwise(F.col("count"))
    rated = rollup.select("device", "template", n.alias("n"), cut.alias("approximate"), span.alias("span"))
    total = rated.groupBy("device").agg(F.sum("n").alias("total"))
    minutes = (until - since) / 60_000
    return rated.join(total, "device").select(
        "device",
        "template",
        "n",
        F.round(F.col("n").cast("double") / F.lit(float(minutes)), 1).alias("per_min"),
        F.when((F.col("n") >= BURST_SAMPLES) & (F.col("span") >= 1), F.round(F.col("n").cast("double") / (F.col("span") / 60_000.0), 1)).alias("burst_per_min"),
        F.least(F.lit(100.0), F.round(F.col("n") * F.lit(100.0) / F.greatest("total", F.lit(1)), 1)).alias("share"),
        "approximate",
    )


def tokens(text: Column) -> Column:
    """Tokens of a line: escapes are stripped, white space splits, and three or more key=value tokens are parted in two each."""
    plain = F.when(F.contains(text, F.lit("\u001b")), F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")).otherwise(text)
    words = F.filter(F.split(plain, r"[ \t\n\r\f]+"), lambda w: w != "")
    pair = lambda w: w.rlike("^[^=]+=[^=].*$")
    parted = F.flatten(F.transform(words, lambda w: F.when(pair(w), F.array(F.concat(F.substring_index(w, "=", 1), F.lit("=")), F.regexp_replace(w, "^[^=]+=", ""))).otherwise(F.array(w))))
    return F.when(F.contains(plain, F.lit("=")) & (F.size(F.filter(words, pair)) >= 3), parted).otherwise(words)


def family(template_tokens: Column) -> Column:
    """The first three literal tokens: templates of one family may be fragments of one message."""
    return F.array_join(F.slice(F.filter(template_tokens, lambda t: t != WILDCARD), 1, 3), "\x01")


def session_stats(lines: DataFrame) -> DataFrame:
    """device, lines, bytes, templates, sessions, families, compression (lines a template) and fragmentation (templates a family), two places.

    What is counted as different is told apart by 64-bit hashes, and lines are first added up by them.
    """
    own = lines.select("device", "session_id", F.octet_length("text").alias("bytes"), tokens(F.col("text")).alias("tokens"))
    worded = F.size("tokens") > 0
    keyed = own.select("device", "session_id", "bytes", F.when(worded, F.xxhash64("tokens")).alias("template"), F.when(worded, F.xxhash64(family(F.col("tokens")))).alias("family"))
    summed = keyed.groupBy("device", "session_id", "template", "family").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"))
    stats = summed.groupBy("device").agg(
        F.sum("lines").alias("lines"),
        F.sum("bytes").alias("bytes"),
        F.countDistinct("template").alias("templates"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("family").alias("families"),
    )
    ratio = lambda a, b: F.round(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)), 2)
    return stats.withColumns({"compression": ratio("lines", "templates"), "fragmentation": ratio("templates", "families")})


def merge_suggestions(templates: DataFrame, similar: float = 0.4) -> DataFrame:
    """a, b, reason, confidence: templates (template_id, tokens) of one family that may be one message.

    Of different lengths: equal literal skeletons give 1, a skeleton that another goes on from gives their lengths' ratio. Of one length: a part of equal
    places (or wildcards) from 0.6 of ``similar`` up to it, near what mining would have joined. Templates without literal tokens say nothing.
    Pairs are compared within a family, as the rule has it, by a join on its key.
    """
    literal = F.filter("tokens", lambda t: t != WILDCARD)
    keyed = templates.select("template_id", "tokens", family(F.col("tokens")).alias("family"), literal.alias("skeleton"), F.size("tokens").alias("n")).where(F.size("skeleton") > 0)
    a, b = (keyed.select("family", *(F.col(c).alias(f"{c}_{x}") for c in ("template_id", "tokens", "skeleton", "n"))) for x in "ab")
    shorter = F.least(F.size("skeleton_a"), F.size("skeleton_b"))
    longer = F.greatest(F.size("skeleton_a"), F.size("skeleton_b"))
    starts = F.slice("skeleton_a", F.lit(1), shorter) == F.slice("skeleton_b", F.lit(1), shorter)
    different = a.join(b, (a["family"] == b["family"]) & (F.col("template_id_a") < F.col("template_id_b")) & (F.col("n_a") != F.col("n_b")) & starts)
    different = different.select(
        "template_id_a", "template_id_b", F.when(shorter == longer, "same_skeleton").otherwise("prefix_extension").alias("reason"), (shorter.cast("double") / longer).alias("confidence")
    )
    equal = F.size(F.filter(F.zip_with("tokens_a", "tokens_b", lambda x, y: (x == y) | (x == WILDCARD)), lambda e: e))
    near = a.join(b, (a["family"] == b["family"]) & (F.col("n_a") == F.col("n_b")) & (F.col("template_id_a") < F.col("template_id_b")))
    near = near.select("template_id_a", "template_id_b", F.lit("near_threshold").alias("reason"), (equal.cast("double") / F.col("n_a")).alias("confidence"))
    near = near.where((F.col("confidence") >= max(0.1, 0.6 * similar)) & (F.col("confidence") < similar))
    both = different.unionByName(near)
    return both.select(F.col("template_id_a").alias("a"), F.col("template_id_b").alias("b"), "reason", F.round("confidence", 4).alias("confidence"))
