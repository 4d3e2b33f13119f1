"""Every read call runs and gives rows; a few against figures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from emberline import queries, views
from emberline.api import Store

NOW = queries.NOW


@pytest.fixture(scope="module")
def store(spark, data):
    verdicts = spark.createDataFrame([("view", "benign")], "template string, verdict string")
    devices = spark.createDataFrame([("usb-a", "alpha", {"rack": "1"}), ("usb-b", "beta", {"rack": "2"})], "device string, nickname string, tags map<string,string>")
    builds = queries._builds(spark, data)
    reports = spark.createDataFrame([("a", ["board", "hangs", "often"]), ("b", ["board", "hangs", "rarely"]), ("c", ["other"])], "id string, words array<string>")
    return Store(views.log_with_epochs(spark, data), views.lines(spark, data), {"verdicts": verdicts, "devices": devices, "builds": builds, "reports": reports})


CALLS = {
    "list_devices": lambda s: s.list_devices(),
    "identify": lambda s: s.identify("alpha"),
    "list_sessions": lambda s: s.list_sessions(limit=3),
    "list_boots": lambda s: s.list_boots(limit=5),
    "boot_stages": lambda s: s.boot_stages(),
    "boot_report": lambda s: s.boot_report(s.log.first()["device"], 0, NOW),
    "stage_timings": lambda s: s.stage_timings(last=5),
    "console_state": lambda s: s.console_state(NOW),
    "list_templates": lambda s: s.list_templates(),
    "template_detail": lambda s: s.template_detail("error", 6),
    "get_records": lambda s: s.get_records("error", n=3, offset=2),
    "stats": lambda s: s.stats(),
    "noise": lambda s: s.noise(NOW - 20 * views.DAY_MS, NOW),
    "rebuild_templates": lambda s: s.rebuild_templates(),
    "list_verdicts": lambda s: s.annotate_template("click", "known_bad").list_verdicts(),
    "search": lambda s: s.search("the"),
    "search_window": lambda s: s.search("the and", scope="window", window=3),
    "search_raw": lambda s: s.search_raw("[a-z]+ing"),
    "get_context": lambda s: s.get_context(1, 0),
    "get_recent": lambda s: s.get_recent(2),
    "diff_boots": lambda s: s.diff_boots(0, 1),
    "diff_builds": lambda s: s.diff_builds("red", "green"),
    "learn_expectations": lambda s: s.learn_expectations(),
    "missing_in_boot": lambda s: s.missing_in_boot(0.5),
    "evaluate_policy": lambda s: s.evaluate_policy(threshold=6),
    "timeline": lambda s: s.timeline(),
    "list_targets": lambda s: s.list_targets(s.log.select("device", (F.col("device") % 3).alias("target"))),
    "list_reports": lambda s: s.list_reports(),
    "decode": lambda s: s.decode(s.log.select(F.col("event_id").alias("value")).limit(5)),
    "list_profiles": lambda s: s.list_profiles(),
    "follow": lambda s: s.follow(500),
    "poll_watch": lambda s: s.poll_watch("w", F.col("template") == "error", 100),
    "prune": lambda s: s.prune(300),
}


@pytest.mark.parametrize("name", CALLS)
def test_call(store, name):
    assert CALLS[name](store).count() > 0


def test_benign_templates_are_hidden_unless_asked_for(store):
    assert "view" not in {r["template"] for r in store.list_templates().collect()}
    assert "view" in {r["template"] for r in store.list_templates(include_benign=True).collect()}


def test_near_reports(store):
    assert [(r["a"], r["b"], r["shared"]) for r in store.list_reports().collect()] == [("a", "b", 2)]


def test_near_reports_as_every_pair_compared_and_no_pairs_are_sent(spark):
    import random

    from emberline.operators import reports

    rng = random.Random(3)
    sets = {f"r{k}": sorted({f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 14))}) for k in range(120)}
    sets["r7"], sets["r8"] = sets["r6"], sets["r6"][1:]
    found = reports.near_reports(spark.createDataFrame(list(sets.items()), "id string, words array<string>"), 2, 0.45)
    wanted = set()
    for a in sets:
        for b in sets:
            shared = len(set(sets[a]) & set(sets[b]))
            if a < b and shared >= 2 and shared / len(set(sets[a]) | set(sets[b])) >= 0.45:
                wanted.add((a, b, shared))
    got = [(r["a"], r["b"], r["shared"]) for r in found.collect()]
    assert wanted and sorted(got) == sorted(wanted)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
