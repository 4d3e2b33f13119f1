"""The read calls of a log store, a method each; every one returns a DataFrame.

A ``Store`` holds logical tables: ``log`` (device, event_id, at, template, severity, boot, value, props) and
``lines`` (device, session_id, line_no, text), and optional small tables for verdicts, baselines,
watches, metrics, images and annotations. Calls that change something return the changed table; calls that
drive hardware are not part of a query engine and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import decode as decoding
from emberline.functions import text as texts
from emberline.operators import compare, epochs, mining, reports, search, templates, values
from emberline.sources.profiles import PROFILES


@dataclass(frozen=True)
class Store:
    log: DataFrame
    lines: DataFrame
    small: dict[str, DataFrame] = field(default_factory=dict)

    # Derived tables

    def rollup(self) -> DataFrame:
        return templates.occurrences(self.log)

    def epochs(self) -> DataFrame:
        return epochs.epoch_table(self.log)

    def _own(self, df: DataFrame, device) -> DataFrame:
        return df if device is None else df.where(F.col("device") == device)

    # Devices, sessions, epochs

    def list_devices(self) -> DataFrame:
        return self.log.groupBy("device").agg(F.count(F.lit(1)).alias("records"), F.max("at").alias("last_at"))

    def identify(self, selector: str) -> DataFrame:
        return reports.select_devices(self.small["devices"], selector)

    def list_sessions(self, device=None, limit: int = 20) -> DataFrame:
        grouped = self._own(self.lines, device).groupBy("device", "session_id").agg(F.count(F.lit(1)).alias("lines"))
        return grouped.orderBy(F.desc("session_id")).limit(limit)

    def list_boots(self, device=None, limit: int = 20) -> DataFrame:
        return self._own(self.epochs(), device).orderBy(F.desc("seq"), "device").limit(limit)

    def boot_stages(self, device=None) -> DataFrame:
        return self._own(epochs.stage_durations(self.log, self.epochs()), device)

    def boot_report(self, device, boot: int, now: int) -> DataFrame:
        """One row: the epoch, its outcome, new templates, and how its fingerprint repeats."""
        known = self._own(self.epochs(), device)
        outcome = epochs.outcomes(known, self._own(self.log, device), now)
        first = self._own(self.rollup(), device).groupBy("device", "template").agg(F.min("boot").alias("seq"))
        novel = first.groupBy("device", "seq").agg(F.array_sort(F.collect_list("template")).alias("novel"))
        own = epochs.with_runs(known).where(F.col("seq") == boot)
        return own.join(outcome, ["device", "seq"]).join(novel, ["device", "seq"], "left")

    def stage_timings(self, device=None, last: int | None = None) -> DataFrame:
        durations = self._own(epochs.stage_durations(self.log, self.epochs()), device)
        if last is not None:
            newest = durations.groupBy("device").agg(F.max("seq").alias("_newest"))
            durations = durations.join(newest, "device").where(F.col("seq") > F.col("_newest") - last).drop("_newest")
        return epochs.stage_timings(durations)

    def console_state(self, now: int, quiet_ms: int = 5000) -> DataFrame:
        """Per device: looping, crashed, hung, quiet or streaming."""
        known = self.epochs()
        newest = known.groupBy("device").agg(F.max("seq").alias("seq"))
        outcome = epochs.outcomes(known, self.log, now).join(newest, ["device", "seq"])
        loops = epochs.loop_class(known).select("device", "kind")
        last = self.log.groupBy("device").agg(F.max("at").alias("last_at"))
        state = (
            F.when(F.col("kind").isin("crash", "stable", "flapping"), F.concat(F.lit("loop_"), F.col("kind")))
            .when(F.col("outcome").isin("crashed", "hung"), F.col("outcome"))
            .when(F.lit(now) - F.col("last_at") >= quiet_ms, "quiet")
            .otherwise("streaming")
        )
        return outcome.join(loops, "device").join(last, "device").select("device", state.alias("state"))

    # Templates

    def list_templates(self, **scope) -> DataFrame:
        """See ``templates.table_of_contents``; benign templates are hidden unless asked for."""
        if "verdicts" in self.small and "verdicts" not in scope:
            scope["verdicts"] = self.small["verdicts"]
            if not scope.pop("include_benign", False) and "only_verdict" not in scope:
                scope["hide_verdict"] = ["benign"]
        return templates.table_of_contents(self.rollup(), **{"limit": 50, **scope})

    def template_detail(self, template: str, buckets: int = 24) -> DataFrame:
        return templates.timeline(self.log, template, buckets)

    def get_records(self, template: str, device=None, n: int = 20, offset: int = 0) -> DataFrame:
        own = self._own(self.log, device).where(F.col("template") == template).orderBy("event_id")
        return (own.offset(offset) if offset else own).limit(n)

    def stats(self) -> DataFrame:
        return templates.session_stats(self.lines)

    def noise(self, since: int, until: int, limit: int = 20) -> DataFrame:
        return templates.noise(self.log, since, until).orderBy(F.desc("n"), "device", "template").limit(limit)

    def rebuild_templates(self) -> DataFrame:
        return mining.mine(self.lines, ["session_id", "line_no"])[1]

    def annotate_template(self, template: str, verdict: str) -> Store:
        row = self.log.sparkSession.createDataFrame([(template, verdict)], "template string, verdict string")
        old = self.small.get("verdicts", row.limit(0)).select("template", "verdict")
        return replace(self, small={**self.small, "verdicts": old.join(row, "template", "left_anti").unionByName(row)})

    def list_verdicts(self) -> DataFrame:
        return self.small["verdicts"]

    # Search

    def search(self, query: str, mode: str = "terms", scope: str = "line", window: int = 20, device=None, limit: int = 50) -> DataFrame:
        text = F.col("text")
        condition = {"terms": search.has_terms, "tokens": search.has_tokens, "phrase": search.has_phrase, "regex": lambda t, q: t.rlike(q)}[mode](text, query)
        lines = self._own(self.lines, device)
        if scope == "window":
            return search.search_windows(lines, window, condition).limit(limit)
        hits = search.search_lines(lines, condition)
        return search.across_devices(hits, limit) if device is None else hits.orderBy("session_id", "line_no").limit(limit)

    def search_raw(self, pattern: str, device=None, limit: int = 50) -> DataFrame:
        return self.search(pattern, mode="regex", device=device, limit=limit)

    def get_context(self, session_id: int, line_no: int, before: int = 5, after: int = 5) -> DataFrame:
        anchor = self.log.sparkSession.createDataFrame([(session_id, line_no)], "session_id long, line_no int")
        return search.context(self.lines, anchor, before, after)

    def get_recent(self, n: int = 50, **how) -> DataFrame:
        return search.recent(self.lines, n, **how)

    # Comparison

    def diff_boots(self, a: int, b: int) -> DataFrame:
        return compare.diff_epochs(self.rollup(), a, b)

    def diff_stages(self, a: int, b: int) -> DataFrame:
        """The stages of ``diff_boots``: the largest delay first, stages of one epoch only last."""
        reach = epochs.stage_reach(self.log, self.epochs())
        return compare.diff_stages(reach, a, b).orderBy(F.desc_nulls_last("delta_ms"), "device", "stage")

    def diff_sessions(self, a: int, b: int) -> DataFrame:
        own = self.lines.select("session_id", F.array_join(templates.tokens(F.col("text")), " ").alias("template"))
        counts = lambda n: own.where(F.col("session_id") == n).groupBy("template").agg(F.count(F.lit(1)).alias("count"))
        return compare.diff_counts(counts(a), counts(b), ["template"])

    def diff_builds(self, a: str, b: str) -> DataFrame:
        return compare.diff_builds(self.rollup(), self.small["builds"], a, b)

    def learn_expectations(self, min_boots: int = 3) -> DataFrame:
        return compare.learn_expectations(self.rollup(), self.epochs(), min_boots)

    def missing_in_boot(self, min_reliability: float = 0.9, late_factor: float = 3.0) -> DataFrame:
        return compare.missing_in_epoch(self.learn_expectations(), self.rollup(), self.epochs(), min_reliability, late_factor)

    def boots_for_image(self, reference: str) -> DataFrame:
        return compare.epochs_of_image(self.small["image_of_epoch"], self.small["images"], reference)

    def set_baseline(self, device, boot: int) -> Store:
        row = self.log.sparkSession.createDataFrame([(device, boot)], "device long, seq long")
        old = self.small.get("baselines", row.limit(0))
        return replace(self, small={**self.small, "baselines": old.unionByName(row).distinct()})

    def list_baselines(self) -> DataFrame:
        return self.small["baselines"].join(self.epochs(), ["device", "seq"])

    # Values

    def template_values(self, samples: DataFrame) -> DataFrame:
        return values.slot_summary(samples)

    def metric_series(self, samples: DataFrame, how: str = "last") -> DataFrame:
        return values.metric_series(samples, how)

    # Reports

    def evaluate_policy(self, threshold: int = 3, **how) -> DataFrame:
        return reports.evaluate_policy(templates.table_of_contents(self.rollup()), threshold=threshold, **how)

    def timeline(self, *evidence: DataFrame) -> DataFrame:
        crashes = self.log.where("severity <= 3").select("device", "at", F.lit("crash").alias("kind"), F.col("template").alias("detail"))
        opened = self.epochs().select("device", F.col("opened_at").alias("at"), F.lit("epoch_open").alias("kind"), F.col("seq").cast("string").alias("detail"))
        return reports.timeline(crashes, opened, *evidence)

    def target_context(self, members: DataFrame, around: int, window_ms: int = 10_000, per_device: int = 20) -> DataFrame:
        return reports.interleave(self.log, members, around, window_ms, per_device)

    def list_targets(self, members: DataFrame) -> DataFrame:
        return members.groupBy("target").agg(F.array_sort(F.collect_set("device")).alias("devices"))

    def provenance(self, versions: DataFrame, intended: DataFrame) -> DataFrame:
        return reports.provenance(versions, intended)

    def backfill_versions(self) -> DataFrame:
        found = self.lines.select("device", "session_id", "line_no", texts.version(F.col("text")).alias("v")).where("v is not null")
        return found.select("device", "session_id", "line_no", "v.*").dropDuplicates(["device", "session_id", "component", "version"])

    def list_reports(self, similarity: float = 0.45) -> DataFrame:
        return reports.near_reports(self.small["reports"], similarity=similarity)

    def decode(self, numbers: DataFrame) -> DataFrame:
        v = F.col("value")
        return numbers.select(
            "value", decoding.errno(v).alias("errno"), decoding.psci(v).alias("psci"), decoding.exception_class(v).alias("exception"),
            decoding.fault_status(v).alias("fault"), decoding.interrupt(v).alias("interrupt"),
        )

    def symbolize(self, addresses: DataFrame, symbols: DataFrame) -> DataFrame:
        return reports.symbolize(addresses, symbols)

    def list_profiles(self) -> DataFrame:
        rows = [(p.name, p.stage, p.rank) for p in PROFILES]
        return self.log.sparkSession.createDataFrame(rows, "name string, stage string, rank int")

    def bisect_next(self, cases: DataFrame, results: DataFrame) -> DataFrame:
        return reports.bisect_steps(cases, results)

    # Streams and retention

    def follow(self, since: int) -> DataFrame:
        return reports.increment(self.log, since)

    def follow_start(self, grace: int = 4096, lookback: int = 262_144) -> DataFrame:
        return epochs.default_start(self.log, epochs.opened_positions(self.log), grace, lookback)

    def create_watch(self, name: str, template: str, delivered_to: int = -1) -> Store:
        row = self.log.sparkSession.createDataFrame([(name, template, "active", delivered_to)], "watch string, template string, status string, delivered_to long")
        old = self.small.get("watches", row.limit(0)).join(row, "watch", "left_anti")
        return replace(self, small={**self.small, "watches": old.unionByName(row)})

    def list_watches(self) -> DataFrame:
        return self.small["watches"]

    def undelivered_hits(self) -> DataFrame:
        hits = self.log.join(self.small["watches"].select("watch", "template"), "template").select("watch", "event_id", "at", "template")
        return reports.undelivered(hits, self.small["watches"])

    def poll_watch(self, name: str, condition, since: int = -1) -> DataFrame:
        return reports.watch_hits(self.log, name, condition, since)

    def prune(self, keep_bytes: int) -> DataFrame:
        """Where each device's log may be cut; baseline epochs and what follows them stay."""
        protected = None
        if "baselines" in self.small:
            protected = self.list_baselines().groupBy("device").agg(F.min("opened_at").alias("protected_at"))
        return reports.retention(self.log, keep_bytes, protected=protected)
