"""The query catalogue, bound to the driver's tables (see ``emberline.views``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import views
from emberline.functions import decode, text
from emberline.operators import compare, epochs, framing, mining, reports, search, templates, values
from emberline.operators.index import Index
from emberline.operators.mining_store import MinedStore
from emberline.session import Scratch
from emberline.sources.profiles import PROFILES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: A time just after the events of the driver's tables (2024-02-01).
NOW = 1_706_745_600_000
DAY = views.DAY_MS


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return templates.occurrences(views.log_with_epochs(spark, sf))


def _verdicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("view", "benign"), ("click", "benign"), ("error", "known_bad")], "template string, verdict string")


# Table of contents


@query
def toc_by_count(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), order="count", limit=4)


@query
def toc_by_severity(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), order="severity", min_severity=5, limit=10)


@query
def toc_first_seen(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), order="first_seen", limit=3)


@query
def toc_last_seen(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), order="last_seen", limit=2, offset=1)


@query
def toc_scoped_boot(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), boot=3, min_count=2)


@query
def toc_new_only(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), boot=1, new_only=True)


@query
def toc_new_only_without_session(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), new_only=True)


@query
def toc_vs_baseline(spark, sf):
    rollup = _rollup(spark, sf)
    return templates.table_of_contents(rollup, device=7, not_in=rollup.where("device = 7 and boot = 0"))


@query
def toc_hide_benign(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), verdicts=_verdicts(spark), hide_verdict=["benign"])


@query
def toc_only_verdict(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf), verdicts=_verdicts(spark), only_verdict=["known_bad"])


@query
def occurrence_rollup(spark, sf):
    return _rollup(spark, sf)


@query
def count_templates(spark, sf):
    return templates.table_of_contents(_rollup(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query
def template_detail_timeline(spark, sf):
    return templates.timeline(views.log(spark, sf), "error", 24)


@query
def distinct_templates_per_boot(spark, sf):
    return _rollup(spark, sf).select("device", "boot", "template").distinct()


@query
def noise_window(spark, sf):
    return templates.noise(views.log(spark, sf), NOW - 16 * DAY, NOW)


@query
def noisiest_templates(spark, sf):
    rated = templates.noise(views.log(spark, sf), NOW - 16 * DAY, NOW)
    return rated.orderBy(F.desc("n"), "device", "template").limit(20)


# Sessions, families, merging


@query
def session_stats(spark, sf):
    return templates.session_stats(views.lines(spark, sf))


@query
def merge_suggestions(spark, sf):
    own = views.lines(spark, sf).select(templates.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).distinct()
    keyed = own.select(F.array_join("tokens", " ").alias("template_id"), "tokens")
    return templates.merge_suggestions(keyed).withColumnsRenamed({"a": "template_a", "b": "template_b"})


@query
def key_value_tokenize(spark, sf):
    built = F.concat(F.lit("user="), F.col("device"), F.lit(" kind="), F.col("template"), F.lit(" sev="), F.col("severity"), F.lit(" done"))
    return views.log(spark, sf).select("event_id", F.array_join(templates.tokens(built), "|").alias("tokens"))


@query
def line_split(spark, sf):
    return views.lines(spark, sf).select("session_id", "line_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def severity_classify(spark, sf):
    made = F.concat(F.when(F.col("event_id") % 5 == 0, "<2>").otherwise(""), F.col("template"), F.when(F.col("event_id") % 7 == 0, " warning: slow").otherwise(""), F.when(F.col("event_id") % 11 == 0, " Debug").otherwise(""))
    return views.log(spark, sf).select("event_id", text.severity(made).cast("int").alias("severity")).withColumn("name", decode.severity_name(F.col("severity")))


@query
def mine_key(spark, sf):
    stamp = F.concat(F.lit("<6>[  "), (F.col("event_id") % 100).cast("string"), F.lit(".000123] \u001b[1m"), F.col("template"), F.lit("\u001b[0m ready "))
    return views.log(spark, sf).select("event_id", text.mine_key(stamp).alias("key"))


@query
def version_extract(spark, sf):
    made = F.concat(F.lit("[ 0.0] Linux version 6."), (F.col("event_id") % 9).cast("string"), F.lit(".1-rc2 (builder@host) #1 SMP"))
    line = F.when(F.col("event_id") % 3 == 0, made).when(F.col("event_id") % 3 == 1, F.lit("U-Boot SPL 2024.01 (Jan 08 2024)")).otherwise(F.col("template"))
    found = views.log(spark, sf).select("event_id", text.version(line).alias("v"))
    return found.where("v is not null").select("event_id", "v.component", "v.version", "v.build_date")


@query
def build_tokens(spark, sf):
    made = F.concat(F.lit("fp="), F.md5(F.col("device").cast("string")), F.lit(" git=abc"), (F.col("event_id") % 4).cast("string"), F.lit(" x "), F.sha1(F.col("template")))
    return views.log(spark, sf).select("event_id", F.array_join(text.build_ids(made), ",").alias("ids"))


@query
def json_fields(spark, sf):
    return views.log(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Lines, records, search


@query
def line_context(spark, sf):
    lines = views.lines(spark, sf)
    anchors = lines.where(search.has_phrase(F.col("text"), "license")).select("session_id", "line_no")
    return search.context(lines, anchors, 2, 2)


@query
def recent_lines(spark, sf):
    return search.recent(views.lines(spark, sf), 5)


@query
def recent_suppress_noise(spark, sf):
    return search.recent(views.lines(spark, sf), 5, mute=F.col("stage") == "en")


@query
def records_for_template(spark, sf):
    rows = views.records(spark, sf).where("kind = 'user'")
    return rows.select("session_id", "record_no", F.size("lines").cast("long").alias("n_lines"))


@query
def record_text(spark, sf):
    lines = views.lines(spark, sf)
    spans = lines.groupBy("session_id", F.expr("line_no div 4").alias("part")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    records = spans.select(F.concat_ws("-", "session_id", "part").alias("record_id"), "session_id", "first_line", "last_line")
    return search.lines_of_records(records, lines)


@query
def template_of_line_interval(spark, sf):
    lines = views.lines(spark, sf)
    spans = lines.groupBy("session_id", F.expr("line_no div 3").alias("part")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    spread = spans.select("session_id", "part", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    return lines.join(spread, ["session_id", "line_no"]).select("session_id", "line_no", "part")


@query
def search_terms(spark, sf):
    return search.search_lines(views.lines(spark, sf), search.has_terms(F.col("text"), "The AND")).select("device", "session_id", "line_no")


@query
def search_tokens(spark, sf):
    return search.search_lines(views.lines(spark, sf), search.has_tokens(F.col("text"), "license the")).select("device", "session_id", "line_no")


@query
def search_index(spark, sf):
    return search.indexed_terms(search.postings(views.lines(spark, sf)), "license the")


@query
def search_phrase(spark, sf):
    return search.search_lines(views.lines(spark, sf), search.has_phrase(F.col("text"), "of the")).select("device", "session_id", "line_no")


@query
def search_regex(spark, sf):
    return search.search_lines(views.lines(spark, sf), F.col("text").rlike(r"\b[A-Z][a-z]+ing\b")).select("device", "session_id", "line_no")


@query
def search_resume(spark, sf):
    found = search.search_lines(views.lines(spark, sf), search.has_phrase(F.col("text"), "the"), after=(20, 3), limit=50)
    return found.select("device", "session_id", "line_no")


@query
def search_record(spark, sf):
    return search.search_records(views.records(spark, sf), search.has_phrase(F.col("text"), "der")).select("session_id", "record_no", "kind")


@query
def search_window(spark, sf):
    condition = search.has_terms(F.col("text"), "license idiot") | search.has_terms(F.col("text"), "stupid the")
    return search.search_windows(views.lines(spark, sf), 5, condition)


@query
def search_cross_device(spark, sf):
    hits = search.search_lines(views.lines(spark, sf), search.has_phrase(F.col("text"), "and"))
    return search.across_devices(hits, 40)


@query
def search_highlights(spark, sf):
    found = search.highlights(F.col("text"), "the")
    rows = views.lines(spark, sf).select("session_id", "line_no", F.posexplode(found).alias("k", "span"))
    return rows.select("session_id", "line_no", "k", "span.start", "span.end")


# Epochs


@query
def boots_sessionized(spark, sf):
    return views.epochs(spark, sf).drop("fingerprint")


@query
def boot_bytes(spark, sf):
    return views.epochs(spark, sf).groupBy("device").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("epochs"))


@query
def boot_fingerprint(spark, sf):
    return views.epochs(spark, sf).select("device", "seq", "fingerprint")


@query
def fingerprint_runs(spark, sf):
    return epochs.fingerprint_runs(views.epochs(spark, sf))


@query
def fingerprint_histogram(spark, sf):
    return epochs.fingerprint_histogram(views.epochs(spark, sf), 12)


@query
def loop_class(spark, sf):
    return epochs.loop_class(views.epochs(spark, sf))


@query
def boot_outcome(spark, sf):
    return epochs.outcomes(views.epochs(spark, sf), views.log_with_epochs(spark, sf), NOW)


@query
def previous_boot(spark, sf):
    return epochs.previous_epoch(views.epochs(spark, sf))


@query
def boot_at_asof(spark, sf):
    points = views.log(spark, sf).where("template = 'error'").select(F.col("event_id").alias("point_id"), "device", (F.col("at") + 1000).alias("at"))
    return epochs.epoch_at(views.epochs(spark, sf), points)


@query
def stage_reach(spark, sf):
    return epochs.stage_reach(views.log_with_epochs(spark, sf), views.epochs(spark, sf))


@query
def stage_durations(spark, sf):
    return epochs.stage_durations(views.log_with_epochs(spark, sf), views.epochs(spark, sf))


@query
def stage_timings(spark, sf):
    return epochs.stage_timings(epochs.stage_durations(views.log_with_epochs(spark, sf), views.epochs(spark, sf)))


# Comparison


@query
def diff_boots(spark, sf):
    return compare.diff_epochs(_rollup(spark, sf), 1, 2)


@query
def diff_sessions(spark, sf):
    log = views.log(spark, sf)
    counts = lambda rows: rows.groupBy("template").agg(F.count(F.lit(1)).alias("count"))
    return compare.diff_counts(counts(log.where("device = 3")), counts(log.where("device = 5")), ["template"])


def _builds(spark: SparkSession, sf: str) -> DataFrame:
    return views.epochs(spark, sf).select("device", F.col("seq").alias("boot"), F.when(F.col("seq") % 3 == 0, "red").when(F.col("seq") % 3 == 1, "green").otherwise("blue").alias("build"))


@query
def diff_builds(spark, sf):
    return compare.diff_builds(_rollup(spark, sf), _builds(spark, sf), "red", "green")


@query
def diff_common_stages(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("stage"))
    return compare.restrict_to_common_stages(docs.where("id % 2 = 0"), docs.where("id % 2 = 1 and stage in ('de', 'en')"))


@query
def learn_expectations(spark, sf):
    return compare.learn_expectations(_rollup(spark, sf), views.epochs(spark, sf), 3)


@query
def missing_in_boot(spark, sf):
    rollup, known = _rollup(spark, sf), views.epochs(spark, sf)
    return compare.missing_in_epoch(compare.learn_expectations(rollup, known, 3), rollup, known, min_reliability=0.6)


# Values


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    log = views.log_with_epochs(spark, sf)
    return log.select("device", "boot", "template", F.lit("k").alias("slot"), "at", F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("value"))


@query
def template_values(spark, sf):
    return values.slot_summary(_samples(spark, sf))


@query
def number_parse(spark, sf):
    v = F.col("event_id")
    made = F.when(v % 6 == 0, F.concat(F.lit("0x"), F.lower(F.hex(v)))).when(v % 6 == 1, F.concat(v.cast("string"), F.lit("ms,"))).when(v % 6 == 2, F.concat(F.lit("-"), v.cast("string"), F.lit(".5"))).when(v % 6 == 3, F.lit("1.2.3")).when(v % 6 == 4, F.lit("word")).otherwise(F.concat(F.lit("("), v.cast("string"), F.lit("%)")))
    return views.log(spark, sf).select("event_id", values.number(made).alias("number"))


@query
def metric_series(spark, sf):
    return values.metric_series(_samples(spark, sf), "last")


@query
def metric_series_stats(spark, sf):
    return values.series_stats(values.metric_series(_samples(spark, sf), "max"))


# Reports


@query
def evaluate_policy(spark, sf):
    toc = templates.table_of_contents(_rollup(spark, sf))
    allowed = spark.createDataFrame([("purchase",)], "template string")
    return reports.evaluate_policy(toc, threshold=6, allowed=allowed, verdicts=_verdicts(spark))


@query
def timeline(spark, sf):
    log = views.log(spark, sf)
    crashes = log.where("severity <= 3").select("device", "at", F.lit("crash").alias("kind"), F.col("template").alias("detail"))
    opened = views.epochs(spark, sf).select("device", F.col("opened_at").alias("at"), F.lit("epoch_open").alias("kind"), F.col("seq").cast("string").alias("detail"))
    orders = views.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    evidence = orders.select(F.col("o_custkey").alias("device"), views.millis("o_orderdate").alias("at"), F.lit("evidence").alias("kind"), F.col("o_orderkey").cast("string").alias("detail"))
    return reports.timeline(crashes, opened, evidence)


@query
def target_interleave(spark, sf):
    members = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("device"), F.col("c_nationkey").alias("target"))
    return reports.interleave(views.log(spark, sf), members, NOW - 15 * DAY, 6 * 3_600_000, 5)


@query
def provenance(spark, sf):
    log = views.log_with_epochs(spark, sf)
    printed = log.where("template = 'view' and event_id % 4 = 0").select("device", "boot", F.lit("kernel").alias("component"), F.concat(F.lit("6.1-g"), F.substring(F.md5((F.col("event_id") % 3).cast("string")), 1, 12)).alias("version"), "at")
    intended = views.epochs(spark, sf).select("device", F.col("seq").alias("boot"), F.when(F.col("seq") % 4 != 0, F.substring(F.md5(F.lit("1")), 1, 10)).alias("build"))
    return reports.provenance(printed, intended)


@query
def latest_versions(spark, sf):
    log = views.log_with_epochs(spark, sf)
    return reports.latest_versions(log.select("device", "boot", F.col("template").alias("component"), F.col("props").alias("version"), "at"))


@query
def report_dedupe(spark, sf):
    rows = views.records(spark, sf).select(F.concat_ws("/", "session_id", "record_no").alias("id"), text.report_words(F.array_join("lines", " ")).alias("words"))
    found = reports.near_reports(rows, least_shared=2, similarity=0.45)
    return found.withColumnsRenamed({"a": "report_a", "b": "report_b"})


@query
def distinct_reporters(spark, sf):
    return views.log(spark, sf).groupBy("template").agg(F.countDistinct("device").alias("reporters"))


@query
def bisect_next_step(spark, sf):
    """A case a device: its records test one of 10 candidates each; errors are bad, purchases can't be judged."""
    log = views.log(spark, sf)
    verdict = F.when(F.col("template") == "error", "bad").when(F.col("template") == "purchase", "skip").otherwise("good")
    results = log.where("event_id % 4 = 0").select(F.col("device").alias("case_id"), (F.col("event_id") % 10).cast("int").alias("index"), verdict.alias("verdict"))
    return reports.bisect_steps(log.select(F.col("device").alias("case_id"), F.lit(10).alias("n")).distinct(), results.distinct())


@query
def bisect_orders(spark, sf):
    """A case a customer: orders test one of 12 candidates each, the ones from the customer's culprit on are bad, some can't be tested."""
    customers = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.lit(12).alias("n"))
    tested = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 12).cast("int").alias("index")).distinct()
    skipped = (F.col("case_id") + F.col("index")) % 5 == 0
    verdict = F.when(skipped, "skip").when(F.col("index") < F.col("case_id") % 14, "good").otherwise("bad")
    return reports.bisect_steps(customers, tested.withColumn("verdict", verdict))


@query
def report_copies(spark, sf):
    rows = views.records(spark, sf).select(F.concat_ws("/", "session_id", "record_no").alias("id"), F.array_join("lines", " ").alias("text"))
    return reports.same_reports(rows)


@query
def decode_ints(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("v"))
    n = F.col("v")
    return rows.select(
        "l_orderkey", "l_linenumber", decode.errno(-n).alias("errno"), decode.psci(-(n % 12)).alias("psci"), decode.interrupt(n * 21).alias("interrupt"),
        decode.exception_class(F.shiftleft(n, 26).cast("long").bitwiseOR(n)).alias("exception"), decode.fault_status((n + 4).cast("long") * 67108864 + n).alias("fault"),
    )


@query
def cursors(spark, sf):
    log = views.log(spark, sf)
    made = decode.cursor(F.col("device"), F.col("event_id"))
    read = decode.cursor_offset(F.when(F.col("event_id") % 5 == 0, F.lit("bad")).otherwise(made), F.col("device"), F.lit(500))
    return log.select("event_id", made.alias("cursor_text"), read["state"].alias("state"), read["offset"].alias("offset"))


@query
def selector_cascade(spark, sf):
    devices = views.table(spark, sf, "customer").select(F.col("c_name").alias("device"), F.concat(F.lit("nick"), F.col("c_custkey")).alias("nickname"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("tags"))
    found = None
    for selector in ("NICK7", "customer#000000012", "tag:segment=building", "00000001", "customer00000002", "nothing"):
        own = reports.select_devices(devices, selector).withColumn("selector", F.lit(selector))
        found = own if found is None else found.unionByName(own)
    return found


@query
def symbolize_asof(spark, sf):
    symbols = views.table(spark, sf, "part").select((F.col("p_partkey") * 5000).alias("address"), F.concat(F.lit("fn_"), F.col("p_partkey")).alias("symbol"))
    addresses = views.log(spark, sf).select(F.col("event_id").alias("id"), (F.col("event_id") * 1237 + 17).alias("address"))
    return reports.symbolize(addresses, symbols, most=1 << 16)


# Streams, as batches


@query
def watch_pattern(spark, sf):
    return reports.watch_hits(views.log(spark, sf), "errors", F.col("template") == "error", since=1000)


@query
def watch_any(spark, sf):
    return reports.first_rule(views.log(spark, sf), [("error", F.col("template") == "error"), ("large", F.col("value") > 90)])


@query
def quiet_spells(spark, sf):
    return reports.quiet_spells(views.log(spark, sf), DAY, NOW)


@query
def follow_increment(spark, sf):
    return reports.increment(views.log(spark, sf), 9000)


@query
def retention_cut(spark, sf):
    return reports.retention(views.log(spark, sf), 300)


def stored_index(spark: SparkSession, sf: str) -> Index:
    """An index of all lines, grown by a batch of even sessions and one of odd ones."""
    index, lines = Index(spark, Scratch(spark, "index").folder), views.lines(spark, sf)
    for odd in (0, 1):
        index.append(lines.where(F.col("session_id") % 2 == odd), str(odd))
    return index


@query
def indexed_regex(spark, sf):
    return stored_index(spark, sf).regex("(with|that) [a-z]+ (was|for) ").select("device", "session_id", F.col("line_no").cast("int").alias("line_no"))


@query
def indexed_phrase(spark, sf):
    return stored_index(spark, sf).phrase("of the").select("device", "session_id", F.col("line_no").cast("int").alias("line_no"))


@query
def indexed_words(spark, sf):
    return stored_index(spark, sf).words("of the").withColumn("line_no", F.col("line_no").cast("int"))


# Mining and framing


@query
def drain_templates(spark, sf):
    _, found = mining.mine(views.lines(spark, sf).select("device", "session_id", "line_no", "text"), ["session_id", "line_no"])
    return found.select("device", "template_id", "template_text", "count")


@query
def drain_counts_conserve(spark, sf):
    _, found = mining.mine(views.lines(spark, sf).select("device", "session_id", "line_no", "text"), ["session_id", "line_no"])
    return found.groupBy("device").agg(F.sum("count").alias("lines"))


@query
def mined_batches(spark, sf):
    """Lines of each device in the templates that three batches have left one after the other."""
    store = MinedStore(spark, Scratch(spark, "mined").folder)
    for batch in range(3):
        own = views.lines(spark, sf).where(F.col("session_id") % 3 == batch).select("device", "session_id", "line_no", "text")
        store.append(own, ["session_id", "line_no"], batch)
    return store.templates().groupBy("device").agg(F.sum("count").alias("lines"))


@query
def drain_fragmentation(spark, sf):
    _, found = mining.mine(views.lines(spark, sf).select("device", "session_id", "line_no", "text"), ["session_id", "line_no"])
    return mining.fragmentation(found)


def _console(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each device as a console log with crashes, and loaders and kernels of several versions."""
    log = views.log(spark, sf)
    event = F.col("event_id")
    line = (
        F.when(F.col("template") == "signup", F.concat(F.lit("Linux version 6."), event % 5, F.lit(".0")))
        .when(F.col("template") == "error", "Kernel panic - not syncing: fatal")
        .when(F.col("template") == "click", "Call trace: f+0x1")
        .when(F.col("template") == "purchase", "---[ end trace 0 ]---")
        .when(event % 3 == 0, F.concat(F.lit("U-Boot SPL 202"), event % 6, F.lit(".01")))
        .otherwise(F.concat(F.lit("U-Boot 202"), event % 6, F.lit(".01")))
    )
    return log.select(F.col("device").alias("session_id"), event.alias("line_no"), line.alias("text"))


@query
def frame_records(spark, sf):
    return framing.frame(_console(spark, sf), PROFILES)


@query
def frame_tiles(spark, sf):
    lines = _console(spark, sf)
    records = framing.frame(lines, PROFILES)
    return records.groupBy("session_id").agg(F.sum("n_lines").alias("in_records"))


@query
def stage_machine(spark, sf):
    return framing.stages(_console(spark, sf), PROFILES)


@query
def garbage_runs(spark, sf):
    lines = _console(spark, sf).withColumn("text", F.when(F.col("line_no") % 10 < 3, F.lit("\u0001\u0002\u0003\u0004ab")).otherwise(F.col("text")))
    return framing.garbage_runs(lines)


# Relational


@query
def device_target_rollup(spark, sf):
    """Revenue by nation and year through five tables: templates, records, devices and targets of a large store."""
    t = lambda n: views.table(spark, sf, n)
    items = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = items.join(t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(F.broadcast(t("nation").select("n_nationkey", "n_name", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    joined = joined.join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    return joined.groupBy("r_name", "n_name", "year").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query
def retention_kept(spark, sf):
    cut = reports.retention(views.log(spark, sf), 300).select("device", "cut_event")
    log = views.log(spark, sf)
    edge = log.join(cut, (log["device"] == cut["device"]) & (log["event_id"] == cut["cut_event"])).select(log["device"], F.struct("at", "event_id").alias("edge"))
    kept = log.join(edge, "device").where(F.struct("at", "event_id") >= F.col("edge"))
    return kept.groupBy("device").agg(F.count(F.lit(1)).alias("kept"))


# Views of text, prompts, claims


@query
def overwrite_render(spark, sf):
    made = F.concat(F.lit("10%\r"), F.col("template"), F.lit("\b\b\b!"), F.when(F.col("event_id") % 2 == 0, "\rX").otherwise(""))
    return views.log(spark, sf).select("event_id", text.rendered(made).alias("shown"))


@query
def glob_filter(spark, sf):
    names = views.table(spark, sf, "customer").select(F.col("c_name").alias("device"))
    return names.where(text.matches_globs(F.col("device"), ["Customer#*1?", "*7"], ["*17"]))


@query
def idle_devices(spark, sf):
    return epochs.idle(views.log(spark, sf), NOW)


@query
def prompts_reached(spark, sf):
    return epochs.prompts_reached(views.lines(spark, sf), {"question": r"\?\s*$", "stop": r"\.\s*$", "capital": r"^[A-Z]"})


@query
def epoch_claim(spark, sf):
    log = views.log(spark, sf).select("device", "event_id", "template")
    claims = log.where("template = 'purchase' and event_id % 3 = 0").select("device", F.col("event_id").alias("from_event"), F.concat(F.lit("power-"), F.col("event_id")).alias("claim"))
    return epochs.claim_ranges(log, claims)


@query
def signed_deliveries(spark, sf):
    hits = reports.watch_hits(views.log(spark, sf), "errors", F.col("template") == "error")
    body = F.to_json(F.struct("watch", "event_id"))
    return hits.select("event_id", text.hmac_sha256(body, b"secret").alias("signature"))


@query
def severity_names(spark, sf):
    names = views.log(spark, sf).select("event_id", decode.severity_name(F.col("severity")).alias("name"))
    return names.withColumn("value", decode.severity_value(F.col("name")))


@query
def fields_map(spark, sf):
    made = F.concat(F.lit("a="), F.col("event_id"), F.lit(" b.c=x a="), F.col("device"), F.lit(" noise"))
    fields = text.key_values(made)
    return views.log(spark, sf).select("event_id", F.element_at(fields, "a").alias("a"), F.element_at(fields, F.lit("b.c")).alias("bc"), F.size(fields).alias("n"))


# Epochs by position, groups, images, baselines


def _openers(spark: SparkSession, sf: str) -> DataFrame:
    by = F.when(F.col("seq") % 4 == 0, "session").when(F.col("seq") % 4 == 1, "power").when(F.col("seq") % 4 == 2, "mark").otherwise("reset")
    return views.epochs(spark, sf).select("device", "seq", by.alias("opened_by"))


@query
def boot_attempts(spark, sf):
    return epochs.attempts(views.epochs(spark, sf), _openers(spark, sf)).select("device", "seq", "opened_by", "bytes")


@query
def loop_kinds(spark, sf):
    log, known = views.log_with_epochs(spark, sf), views.epochs(spark, sf)
    of_epoch = log.groupBy("device", F.col("boot").alias("seq"))
    marks = of_epoch.agg(F.max(F.col("event_id") % 3 == 0).alias("watchdog"), F.max(F.col("template") == "purchase").alias("userspace"))
    shaped = known.withColumn("fingerprint", F.concat(F.least("records", F.lit(3)), F.lit("/"), F.col("device") % 2 * (F.col("seq") % 3)))
    return epochs.loop_class(shaped, marks=marks)


@query
def garbage_resolved(spark, sf):
    return epochs.garbage_state(views.log_with_epochs(spark, sf), F.col("event_id") % 13 == 0, F.col("template").isin("signup", "purchase"))


@query
def boot_outcome_ladder(spark, sf):
    log, known = views.log_with_epochs(spark, sf), views.epochs(spark, sf)
    garbage = epochs.garbage_state(log, F.col("event_id") % 13 == 0, F.col("template").isin("signup", "purchase"))
    silent = known.withColumn("bytes", F.when(F.col("seq") % 7 == 3, 0).otherwise(F.col("bytes")))
    attested = known.where("seq % 2 = 0").select("device", "seq")
    newest = log.groupBy("device").agg(F.max_by("template", F.struct("at", "event_id")).alias("last"))
    prompts = newest.where("last in ('view', 'click')").select("device", F.when(F.col("last") == "view", "login").otherwise("shell").alias("kind"))
    return epochs.outcomes(silent, log, NOW, attested=attested, garbage=garbage, prompts=prompts)


@query
def diff_stage_times(spark, sf):
    return compare.diff_stages(epochs.stage_reach(views.log_with_epochs(spark, sf), views.epochs(spark, sf)), 1, 2)


@query
def boot_covering_offset(spark, sf):
    points = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("device"), (F.col("o_orderkey") % 1000).alias("position"))
    return epochs.epoch_covering(epochs.opened_positions(views.log_with_epochs(spark, sf)), points, bucket=100)


@query
def sibling_boots(spark, sf):
    known = views.epochs(spark, sf)
    groups = known.select("device", "seq", F.when(F.col("seq") % 3 != 0, F.concat(F.col("device") % 20, F.lit("-"), F.col("seq"))).alias("group_id"))
    return epochs.siblings(groups, known.groupBy("device").agg(F.max("seq").alias("seq")))


@query
def baseline_protection(spark, sf):
    opened = epochs.opened_positions(views.log_with_epochs(spark, sf))
    return epochs.protected_positions(opened, opened.where("device % 3 = 0 and seq in (1, 2)").select("device", "seq"))


@query
def retention_with_baselines(spark, sf):
    protected = views.epochs(spark, sf).where("device % 3 = 0 and seq in (1, 2)").groupBy("device").agg(F.min("opened_at").alias("protected_at"))
    return reports.retention(views.log(spark, sf), 100, protected=protected)


@query
def follow_default_start(spark, sf):
    opened = epochs.opened_positions(views.log_with_epochs(spark, sf)).where("device % 4 <> 0")
    return epochs.default_start(views.log(spark, sf), opened, 10, 300)


@query
def boots_for_image(spark, sf):
    images = views.table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("name"), F.sha1(F.col("p_partkey").cast("string")).alias("git_sha"), F.md5("p_name").alias("image_hash"))
    ran = views.epochs(spark, sf).select("device", "seq", (F.col("device") + F.col("seq")).alias("image_id"))
    return compare.epochs_of_image(ran, images, "B")


@query
def timeline_of_kind(spark, sf):
    return timeline(spark, sf).where(F.startswith(F.lower("kind"), F.lit("epoch_")))


@query
def undelivered_hits(spark, sf):
    watches = spark.createDataFrame([("errors", "active", 500), ("buys", "active", -1), ("old", "retired", -1)], "watch string, status string, delivered_to long")
    log = views.log(spark, sf)
    hits = reports.watch_hits(log, "errors", F.col("template") == "error").unionByName(reports.watch_hits(log, "buys", F.col("template") == "purchase"))
    return reports.undelivered(hits.unionByName(reports.watch_hits(log, "old", F.col("template") == "view")), watches)


@query
def toc_compact_page(spark, sf):
    compact = templates.table_of_contents(_rollup(spark, sf)).select("template", "count", "severity", "last_ts")
    return templates.page(compact, [F.desc("count"), "template"], 2, 1)


@query
def templates_omitted(spark, sf):
    return templates.capped_lists(_rollup(spark, sf), "device", "template", 2)
